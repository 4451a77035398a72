"""Redaction, addresses, requests, answers."""

import random
import re

import pytest
from pyspark.sql import functions as F

from wardlight.functions import text as X
from wardlight.operators import answers, privacy, requests, triage
from wardlight.sources import readers

TEXTS = [
    "5550100 5550101", "x5550102 (555-0103)",
    "ten digits 4155550123 and 415.555.0123 and 415-555-0123",
    "mail jürgen.müller@straße.example.de now",
    "a@b.com-foo@x.org", "no at sign 12345678901", "user@host", "x@y.z, 5550199", "@", "",
    "id 123-4567-890 and 1234567", "٤١٥٥٥٥٠١٢٣ digits", "é5550123é", "line\nbreak 555-0123\n",
]


def redacted(text):
    text = re.sub(r"[\w\.-]+@[\w\.-]+\.\w+", "[REDACTED_EMAIL]", text)
    return re.sub(r"\b\d{10}\b|\b\d{3}[-.]?\d{3}[-.]?\d{4}\b|\b\d{3}[-.]?\d{4}\b", "[REDACTED_PHONE]", text)


def test_redaction_equals_the_pattern(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, description string")
    got = {r["i"]: r["description"] for r in privacy.redact_pii(rows).collect()}
    assert got == {i: redacted(t) for i, t in enumerate(TEXTS)}
    audit = privacy.pii_audit(privacy.redact_pii(rows)).first()
    assert audit["leaking"] == 0 and audit["texts"] == len(TEXTS)
    assert audit["phone_tokens"] == sum(redacted(t).count("[REDACTED_PHONE]") for t in TEXTS)


def test_redaction_of_random_texts(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice("ab1.-@@ é_5") for _ in range(rng.randrange(40))) for _ in range(4000)]
    texts += ["".join(rng.choice("0123456789-. x") for _ in range(rng.randrange(40))) for _ in range(2000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, description string")
    got = {r["i"]: r["description"] for r in privacy.redact_pii(rows).collect()}
    assert got == {i: redacted(t) for i, t in enumerate(texts)}


def test_a_long_run_is_read_once(spark):
    text = "a" * 400_000 + " x@y.org " + "b.-" * 100_000
    row = privacy.redact_pii(spark.createDataFrame([(text,)], "description string")).first()
    assert row[0] == text.replace("x@y.org", "[REDACTED_EMAIL]")


def test_audit_of_nothing(spark):
    rows = spark.createDataFrame([], "description string")
    assert tuple(privacy.pii_audit(rows).first()) == (0, 0, 0, 0)


@pytest.mark.parametrize("address, zip_code, street", [
    ("9 Elm Rd, Rivertown, 94112", 94112, "9 Elm Rd"),
    ("9 Elm Rd, Rivertown", None, "9 Elm Rd"),
    ("1234567", 34567, "1234567"), ("Oak 02134", 2134, "Oak 02134"), ("Oak 94112\n", 94112, "Oak 94112"),
    ("94112 Oak", None, "94112 Oak"), ("  Elm Rd \t, x", None, "Elm Rd"), ("", None, ""), (None, None, ""),
])
def test_address(spark, address, zip_code, street):
    rows = spark.createDataFrame([(address,)], "address string")
    row = rows.transform(triage.extract_zip).transform(triage.street_of_address).first()
    assert (row["zip_code"], row["street"]) == (zip_code, street)


def test_strip_is_python_strip(spark):
    samples = ["\x1f  a b 　\n", "​ a", " \x85x\x1c", "", "   "]
    rows = spark.createDataFrame([(s,) for s in samples], "s string")
    assert [r[0] for r in rows.select(X.strip(F.col("s"))).collect()] == [s.strip() for s in samples]


def test_requests_from_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(
        '{"service_request_id": 7, "service_name": "Graffiti", "media_url": {"url": "http://x/1.jpg"}}\n'
        '{"service_request_id": "9", "service_subtype": "b", "address": "1 A St", "media_url": "http://x/2.jpg"}\n'
        '{"service_request_id": "8", "media_url": ""}\n{"service_name": "no id"}\n')
    raw = readers.read_requests(spark, str(tmp_path))
    assert [r[0] for r in requests.page(raw, 2, below="95").select("service_request_id").collect()] == ["9", "8"]
    valid, rejects = requests.validate_requests(requests.normalize_request(raw))
    got = {r["incident_id"]: r for r in valid.collect()}
    assert got["7"]["image_url"] == "http://x/1.jpg" and got["7"]["address"] == ""
    assert got["7"]["description"] == "service_name: Graffiti service_subtype:  service_details: "
    assert got["9"]["image_url"] == "http://x/2.jpg" and got["8"]["image_url"] is None
    assert [r["missing"] for r in rejects.collect()] == ["incident_id"]


ANSWERS = [
    ('{"severity": "HIGH", "confidence": 0.9, "reasoning": "r"}', ("ok", "HIGH", 0.9, "r")),
    ('{}', ("ok", "UNKNOWN", 0.0, "No explanation provided")),
    ('{"severity": null, "confidence": 1}', ("ok", None, 1.0, "No explanation provided")),
    ('{"severity": "LOW", "confidence": null}', ("bad_confidence",)),
    ('{"severity": "LOW", "confidence": "0.9"}', ("bad_confidence",)),
    ('{"severity": "LOW", "confidence": "NaN"}', ("bad_confidence",)),
    ("not json", ("malformed",)), ("", ("malformed",)), (None, ("malformed",)), ("[1]", ("malformed",)),
    ('{"severity": "LOW"} and more', ("malformed",)), ("{'severity': 'LOW'}", ("malformed",)),
    ('{"severity": "LOW"},{}', ("malformed",)), ('[{"severity": "LOW"}]', ("malformed",)),
    ('{"severity": "LOW", "confidence": 0.1}]', ("malformed",)),
    ('{"severity": "LOW", "confidence": 0.1}] trailing junk', ("malformed",)),
    ('{"severity": "LOW", "confidence": 0.1}, "reasoning": "x"', ("malformed",)),
    ('{"severity": "LOW", "confidence": 0.1}, {"severity": "HIGH"}', ("malformed",)),
    ('{"severity": "LOW"}, "after_the_text_4f1c": 1}', ("malformed",)),
    (' {"severity": "LOW", "confidence": 0.1, "reasoning": "a\\nb"} ', ("ok", "LOW", 0.1, "a\nb")),
]


def test_answers(spark):
    rows = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(ANSWERS)], "i int, response string")
    got = {r["i"]: r for r in answers.with_parsed_answer(rows).collect()}
    for i, (text, want) in enumerate(ANSWERS):
        row = got[i]
        assert row["parse_status"] == want[0], text
        if want[0] == "ok":
            assert (row["ai_severity"], row["confidence"], row["ai_reasoning"]) == want[1:], text
    ok, rejects = answers.parse_llm_response(rows)
    assert ok.count() + rejects.count() == len(ANSWERS)


def test_prompt_versions(spark):
    rows = spark.createDataFrame([("a {b} $1", "v1.0.0"), ("c", "v9")], "description string, prompt_version string")
    current = answers.render_prompt(rows)[0].collect()
    assert all(r["prompt_version"] == "v1.1.0" and "reasoning" in r["prompt"] for r in current)
    own, rejects = answers.render_prompt(rows, version=None)
    assert [r["prompt_version"] for r in rejects.collect()] == ["v9"]
    own = own.collect()
    assert len(own) == 1 and "Description: a {b} $1\n" in own[0]["prompt"]


def test_reports(spark):
    good = ('{"severity":"High","anomaly_type":"t","source_ip":"i","root_cause":"c","evidence":["e"],'
            '"confidence":"Low","recommended_actions":[]}')
    rows = spark.createDataFrame([(1, good), (2, '{"severity":"High"}'), (3, "x"), (4, None)], "i int, report string")
    reports, rejects = answers.report_from_json(rows)
    assert reports.first()["evidence"] == ["e"] and reports.count() == 1
    assert sorted(r["i"] for r in rejects.collect()) == [2, 3, 4]


def test_runbooks_from_files(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "a.txt").write_text("first\nsecond")
    (tmp_path / "b.txt").write_text(" \n ")
    rows = readers.read_runbooks(spark, str(tmp_path)).collect()
    assert [r["text"] for r in rows] == ["first\nsecond"] and rows[0]["doc_id"].endswith("a.txt")


def test_a_text_is_read_to_its_end(spark):
    texts = ['{"a":1}', ' {"a":1} ', "]", "[", "", "null", "1", '{"a":1}]', '{"a":1},{"a":2}', '{"a":1} trailing', '[{"a":1}', '[]', '{"a":1},', "{}", '"x"',
             '{"a":"]"}', '{"a":1},"b"', None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = rows.select(F.size(X.json_objects(F.col("t"), "struct<a:string>")).alias("n"), X.single(X.json_objects(F.col("t"), "struct<a:string>")).alias("one"))
    told = dict(zip(texts, [r["one"] for r in got.collect()]))
    assert all(told[t] for t in ('{"a":1}', ' {"a":1} ', "{}", '{"a":"]"}'))
    assert not any(told[t] for t in ("]", "[", "", '{"a":1}]', '{"a":1},{"a":2}', '{"a":1} trailing', '[{"a":1}', '{"a":1},', '{"a":1},"b"', None))
