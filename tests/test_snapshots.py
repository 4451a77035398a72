"""The committed snapshot of a history, the key index and the streams that rest on them."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from test_store import T0, fold_by_hand, incidents, random_actions
from test_streaming import files, forget_last_commit, rows, stream

from wardlight import schemas
from wardlight.operators import requests, reviews, store, triage
from wardlight.plans.fixtures import fixture
from wardlight.sources import sinks, snapshots
from wardlight.sources.sinks import read_batches, read_incidents
from wardlight.streaming import intake

SF_DIR = "/root/testdata/sf0.001"
ORDER = ["batch_id", "created_at", "description", "transformation_log"]


def whole_fold(spark, path):
    """Every batch that was ever written, folded without any snapshot."""
    return rows(store.fold_history(read_batches(spark, path, schemas.INCIDENT), ORDER))


def random_batches(n, seed=5, keys=40, size=12):
    rng = random.Random(seed)
    return [[dict(incident_id=f"k{k}", severity=rng.choice("LMHC"), created_at=T0 + timedelta(days=b), data_source=f"s{b}", description=f"d{b}")
             for k in rng.sample(range(keys), size)] for b in range(n)]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_batches_after_a_compaction_count(spark, tmp_path):
    path = str(tmp_path / "history")
    assert sinks.compact_history(spark, path).version == 0
    for n, batch in enumerate(random_batches(8)):
        sinks.write_batch(incidents(spark, batch), path, n)
        if n in (2, 3, 6):
            done = sinks.compact_history(spark, path, buckets=8)
            assert done.last_batch == n - 1  # the last batch may have to be written again
            sinks.write_batch(incidents(spark, batch), path, n)
        assert rows(read_incidents(spark, path)) == whole_fold(spark, path)
    assert snapshots.versions(spark, path) == [1, 2, 3]
    assert sinks.compact_history(spark, path, through=7).last_batch == 7
    assert sinks.compact_history(spark, path, through=7).version == 4
    assert rows(read_incidents(spark, path)) == whole_fold(spark, path)


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "history")
    for n, batch in enumerate(random_batches(3, keys=200, size=120)):
        sinks.write_batch(incidents(spark, batch), path, n)
    first = sinks.compact_history(spark, path, buckets=16, through=2)
    sinks.write_batch(incidents(spark, [dict(incident_id="k1", severity="NEW"), dict(incident_id="other")]), path, 3)
    second = sinks.compact_history(spark, path, through=3)
    moved = {b for b in second.folders if second.folders[b] != first.folders.get(b)}
    want = spark.createDataFrame([("k1",), ("other",)], "k string").select(snapshots.bucket_of(F.col("k"), 16)).distinct().collect()
    assert moved == {r[0] for r in want} and len(second.folders) > len(moved)
    assert rows(read_incidents(spark, path)) == whole_fold(spark, path)


def test_vacuum_keeps_what_readers_need(spark, tmp_path):
    path = str(tmp_path / "history")
    wanted = None
    for n, batch in enumerate(random_batches(6, keys=60)):
        sinks.write_batch(incidents(spark, batch), path, n)
        sinks.compact_history(spark, path, buckets=8, through=n)
        wanted = whole_fold(spark, path)
    before = read_incidents(spark, path)
    gone = snapshots.vacuum(spark, path)
    assert any("batch_id=4" in g for g in gone) and not any("batch_id=5" in g for g in gone)
    assert rows(read_incidents(spark, path)) == rows(before) == wanted
    assert snapshots.versions(spark, path) == [5, 6] and snapshots.vacuum(spark, path) == []
    sinks.write_batch(incidents(spark, [dict(incident_id="k0", severity="Z")]), path, 6)
    assert read_incidents(spark, path).filter("incident_id = 'k0'").first()["severity"] == "Z"


def test_of_two_compactions_one_gives_way(spark, tmp_path):
    path = str(tmp_path / "history")
    for n, batch in enumerate(random_batches(2)):
        sinks.write_batch(incidents(spark, batch), path, n)
    mine = sinks.compact_history(spark, path, buckets=4)
    assert not snapshots.publish(spark, path, mine)
    assert snapshots.latest(spark, path) == mine and snapshots.versions(spark, path) == [1]


def test_an_unfinished_batch_is_not_folded(spark, tmp_path):
    path = tmp_path / "history"
    for n, batch in enumerate(random_batches(3)):
        sinks.write_batch(incidents(spark, batch), str(path), n)
    (path / "batch_id=2" / "_SUCCESS").unlink()
    assert snapshots.batches(spark, str(path)) == [0, 1]
    assert sinks.compact_history(spark, str(path), buckets=4).last_batch == 0


def test_a_small_batch_does_not_exchange_the_store(spark, tmp_path):
    path = str(tmp_path / "history")
    stored = spark.range(60_000).select(
        F.col("id").cast("string").alias("incident_id"), F.lit("d").alias("description"), F.lit("LOW").alias("severity"),
        F.lit(T0).cast("timestamp_ntz").alias("created_at"))
    sinks.write_batch(store.upsert_incidents(incidents(spark, []), stored), path, 0)
    sinks.compact_history(spark, path, buckets=4, through=0)
    new = spark.range(59_500, 60_500).select(F.col("id").cast("string").alias("incident_id"), F.lit("HIGH").alias("severity"))
    sinks.write_batch(store.upsert_incidents(incidents(spark, []), new, as_of=T0), path, 1)
    got = read_incidents(spark, path)
    assert got.count() == 60_500 and got.filter("severity = 'HIGH'").count() == 1000
    text = got._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    # the scans of the snapshot go straight into broadcast joins
    assert "BroadcastHashJoin" in text and "FullOuter" not in text
    exchanged = read_exchanges(got)
    assert exchanged and all("_snapshots" not in x for x in exchanged)
    assert rows(got.select("incident_id", "severity")) == rows(store.fold_history(
        read_batches(spark, path, schemas.INCIDENT), ORDER).select("incident_id", "severity"))


def read_exchanges(df):
    """Of every hash exchange the scans below it, up to the next exchange or broadcast join."""
    found = []

    def walk(node, scans):
        kind = node.getClass().getSimpleName()
        if kind == "FileSourceScanExec":
            scans.append(node.relation().location().rootPaths().mkString(","))
        children = node.children()
        plans = [children.apply(i) for i in range(children.size())]
        if kind == "AdaptiveSparkPlanExec":
            plans = [node.initialPlan()]
        if kind == "BroadcastHashJoinExec":
            # what is joined row by row with a broadcast is filtered by it
            semi = node.joinType().toString() == "LeftSemi"
            for p in plans:
                walk(p, [] if semi else scans)
            return
        if kind == "ShuffleExchangeExec":
            below = []
            for p in plans:
                walk(p, below)
            found.extend(below or ["rows"])
            return
        for p in plans:
            walk(p, scans)

    walk(df._jdf.queryExecution().executedPlan(), [])
    return found


@pytest.mark.parametrize("way", [store.upsert_incidents, store.upsert_few])
def test_both_upserts_agree(spark, way):
    current = incidents(spark, [dict(incident_id="a", severity="LOW", created_at=T0, human_reviewed=True), dict(incident_id=None, severity="N"), dict(incident_id="b")])
    updates = incidents(spark, [dict(incident_id="a", severity=None, confidence=0.5), dict(incident_id="c", severity="HIGH"), dict(incident_id=None, severity="M")])
    got = sorted(((r["incident_id"], r["severity"], r["confidence"], r["human_reviewed"], r["created_at"]) for r in way(current, updates, as_of=T0).collect()), key=str)
    assert got == sorted([("a", None, 0.5, True, T0), (None, "N", None, None, None), ("b", None, None, None, None),
                          ("c", "HIGH", None, False, T0), (None, "M", None, False, T0)], key=str)
    assert way(current, updates.limit(0)).count() == 3 and way(current.limit(0), updates).count() == 3
    repeated = incidents(spark, [dict(incident_id="a", severity=s, created_at=T0 + timedelta(hours=h)) for s, h in (("X", 1), ("Y", 2))])
    assert way(current, repeated, order=["created_at"]).filter("incident_id = 'a'").first()["severity"] == "Y"


def test_triage_stream_goes_on_across_compactions(spark, tmp_path):
    raw, marks, history = (tmp_path / n for n in ("raw", "marks", "history"))
    joined = requests.normalize_request(fixture(spark, SF_DIR, "requests")).join(fixture(spark, SF_DIR, "answers"), "incident_id")
    repeated = joined.unionByName(joined.filter("CAST(incident_id AS INT) % 3 = 0").withColumn(
        "response", F.lit('{"severity": "CRITICAL", "confidence": 0.95}')))
    files(repeated, raw, "response", 5)

    def run():
        intake.stream_triage(stream(spark, raw, joined.schema), None, str(history), str(marks), as_of="2024-01-01").awaitTermination()
        return rows(read_incidents(spark, str(history)))

    query = intake.stream_triage(
        stream(spark, raw, joined.schema), None, str(history), str(marks), as_of="2024-01-01", trigger={"processingTime": "0 seconds"})
    try:
        # compact while the stream is running, whatever it has got to
        for _ in range(3):
            sinks.compact_history(spark, str(history), buckets=4)
            read_incidents(spark, str(history)).count()
        query.processAllAvailable()
    finally:
        query.stop()
    sinks.compact_history(spark, str(history), buckets=4)
    assert rows(read_incidents(spark, str(history))) == whole_fold(spark, str(history))
    forget_last_commit(marks)
    assert run() == whole_fold(spark, str(history))
    want = whole_fold(spark, str(history))
    assert sinks.compact_history(spark, str(history)).version >= 1
    snapshots.vacuum(spark, str(history), keep=1)
    assert run() == want and len(want) == triage.triage(repeated, as_of="2024-01-01").select("incident_id").distinct().count()


def raw_files(spark, folder, n=6, seed=1):
    folder.mkdir()
    rng = random.Random(seed)
    for i in range(n):
        lines = [f'{{"service_request_id":"{rng.randrange(60)}","service_name":"n"}}' for _ in range(30)]
        (folder / f"{i}.json").write_text("\n".join(lines))


def ingest(spark, raw, stored, marks, **more):
    source = spark.readStream.schema(schemas.RAW_REQUEST).option("maxFilesPerTrigger", 1).json(str(raw))
    intake.stream_ingest(source, str(stored), str(marks), **more).awaitTermination()
    return sorted(r["incident_id"] for r in read_batches(spark, str(stored), schemas.REQUEST).collect())


def test_ingest_over_compacted_keys(spark, tmp_path):
    raw, stored, marks = tmp_path / "raw", tmp_path / "stored", tmp_path / "marks"
    raw_files(spark, raw)
    ids = {line.split('"')[3] for f in raw.iterdir() for line in f.read_text().splitlines()}
    assert ingest(spark, raw, stored, marks, buckets=4, compact_every=2) == sorted(ids)
    keys = f"{stored}/_keys"
    assert snapshots.versions(spark, keys) == [1, 2]
    forget_last_commit(marks)
    assert ingest(spark, raw, stored, marks, buckets=4, compact_every=2) == sorted(ids)
    index = intake.compact_keys(spark, keys)
    assert len(index.folders) == 4
    snapshots.vacuum(spark, keys, keep=1)
    (raw / "new.json").write_text('{"service_request_id":"999","service_name":"n"}\n{"service_request_id":"1","service_name":"n"}')
    assert ingest(spark, raw, stored, marks) == sorted(ids | {"999", "1"})


def test_ingest_reads_only_touched_buckets(spark, tmp_path):
    raw, stored, marks = tmp_path / "raw", tmp_path / "stored", tmp_path / "marks"
    raw_files(spark, raw, 3)
    ingest(spark, raw, stored, marks, buckets=8)
    keys = f"{stored}/_keys"
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    text = plan_of(intake.seen_keys(spark, keys, 2, [1, 5], snapshots.latest(spark, keys, 8)))
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    filters = text.split("PartitionFilters: [", 1)[1].split("PushedFilters", 1)[0]
    assert "bucket#" in filters and "IN (1,5)" in filters and "batch_id#" in filters
    index = intake.compact_keys(spark, keys, 8)
    read = snapshots.folded_rows(spark, index, intake.KEYS, [1, 5]).inputFiles()
    assert read and all(any(f"bucket={b}/" in f for b in (1, 5)) for f in read)


def test_a_store_without_index_is_entered(spark, tmp_path):
    raw, stored, marks = tmp_path / "raw", tmp_path / "stored", tmp_path / "marks"
    raw_files(spark, raw, 2)
    old = spark.createDataFrame([("1", "d", "", None), ("77", "d", "", None)], schemas.REQUEST)
    sinks.write_batch(old, str(stored), -1)
    got = ingest(spark, raw, stored, marks)
    assert len(got) == len(set(got)) and {"1", "77"} <= set(got)


def test_unanswered_requests_are_kept_by_default(spark, tmp_path):
    schema = "incident_id string, description string, address string, image_url string"
    spark.createDataFrame([("a", "lamp", "", None), ("b", "lamp", "", None)], schema).write.parquet(str(tmp_path / "raw"))
    reply = spark.createDataFrame([("a", '{"severity": "LOW", "confidence": 0.9}')], "incident_id string, response string")
    history = str(tmp_path / "history")
    intake.stream_triage(stream(spark, tmp_path / "raw", spark.createDataFrame([], schema).schema), reply, history,
                         str(tmp_path / "marks"), as_of="2024-01-01").awaitTermination()
    assert [r["incident_id"] for r in read_incidents(spark, history).collect()] == ["a"]
    assert {r["incident_id"] for r in spark.read.parquet(f"{history}/_pending").collect()} == {"b"}


ASKED = "incident_id string, description string, address string, image_url string, asked_at timestamp_ntz"
REPLY = "incident_id string, response string, answered_at timestamp_ntz"
GOOD = '{"severity": "LOW", "confidence": 0.9, "reasoning": "r"}'


def at(minutes):
    return datetime(2024, 3, 1) + timedelta(minutes=minutes)


class Answered:
    """Two feeds and a clock as folders of files, and the stream over them."""

    def __init__(self, spark, root):
        self.spark, self.root = spark, root
        for name, schema in (("asked", ASKED), ("replies", REPLY), ("clock", "ts timestamp_ntz")):
            spark.createDataFrame([], schema).write.parquet(f"{root}/{name}")

    def add(self, name, schema, *values):
        self.spark.createDataFrame(list(values), schema).coalesce(1).write.mode("append").parquet(f"{self.root}/{name}")

    def ask(self, *pairs):
        self.add("asked", ASKED, *[(i, "lamp out", "", None, None if m is None else at(m)) for i, m in pairs])

    def reply(self, *pairs, text=GOOD):
        self.add("replies", REPLY, *[(i, text, at(m)) for i, m in pairs])

    def tick(self, m):
        self.add("clock", "ts timestamp_ntz", (at(m),))

    def run(self):
        feeds = [stream(self.spark, f"{self.root}/{n}", self.spark.createDataFrame([], s).schema)
                 for n, s in (("asked", ASKED), ("replies", REPLY), ("clock", "ts timestamp_ntz"))]
        intake.stream_answers(feeds[0], feeds[1], f"{self.root}/history", f"{self.root}/marks", f"{self.root}/rejects", wait="30 minutes",
                              delay="5 minutes", clock=feeds[2], as_of="2024-01-01").awaitTermination()
        done = sorted(str(r["incident_id"]) for r in read_incidents(self.spark, f"{self.root}/history").collect())
        bad = self.spark.read.parquet(f"{self.root}/rejects")
        return done, sorted((str(r["incident_id"]), r["parse_status"]) for r in bad.collect())


def test_answers_before_after_and_never(spark, tmp_path):
    feed = Answered(spark, tmp_path)
    feed.ask(("a", 0), ("never", 2), ("late", 3))
    feed.reply(("early", 1), ("a", 4))
    assert feed.run() == (["a"], [])
    feed.ask(("early", 6), (None, 5))
    feed.reply(("late", 20))
    assert feed.run() == (["a", "early", "late"], [])
    # neither a request nor an answer comes any more; the clock alone lets the unanswered go
    feed.tick(60)
    feed.tick(61)
    done, bad = feed.run()
    assert done == ["a", "early", "late"] and bad == [("None", "unanswered"), ("never", "unanswered")]
    forget_last_commit(tmp_path / "marks")
    assert feed.run() == (done, bad)


def test_an_answer_too_far_away_is_none(spark, tmp_path):
    feed = Answered(spark, tmp_path)
    feed.ask(("a", 0), ("b", 0), ("c", 10))
    feed.reply(("a", 31))
    feed.reply(("b", 30), text="not json")
    feed.reply(("c", 11), ("c", 12), text=GOOD)
    feed.run()
    feed.tick(100)
    feed.tick(101)
    done, bad = feed.run()
    assert done == ["c"] and [i for i, s in bad] == ["a", "b"] and bad[0][1] == "unanswered" and bad[1][1] != "unanswered"


@pytest.mark.parametrize("n_files, seed", [(1, 3), (6, 4)])
def test_reviews_from_a_stream_equal_batch(spark, tmp_path, n_files, seed):
    rows_, tuples = random_actions(seed=seed)
    random.Random(seed).shuffle(tuples)  # actions arrive in any order
    raw, folds, marks = tmp_path / "raw", str(tmp_path / "folds"), tmp_path / "marks"
    step = -(-len(tuples) // n_files)
    for i in range(0, len(tuples), step):
        spark.createDataFrame(tuples[i:i + step], schemas.REVIEW_ACTION).coalesce(1).write.mode("append").parquet(str(raw))
    base = incidents(spark, [dict(incident_id=k, severity="MEDIUM", human_reviewed=False, needs_review=k == "b", transformation_log="t") for k in "abcdef"])
    want = rows(reviews.apply_reviews(base, spark.createDataFrame(tuples, schemas.REVIEW_ACTION)))

    def run():
        intake.stream_reviews(stream(spark, raw, schemas.REVIEW_ACTION), folds, str(marks), compact_every=2).awaitTermination()
        return rows(reviews.apply_fold(base, intake.read_reviews(spark, folds)))

    assert run() == want
    forget_last_commit(marks)
    assert run() == want
    intake.compact_reviews(spark, folds)
    snapshots.vacuum(spark, folds, keep=1)
    assert run() == want
    hand = fold_by_hand(dict(incident_id="a", severity="MEDIUM", human_reviewed=False, needs_review=False, transformation_log=""),
                        [a for a in rows_ if a["incident_id"] == "a"])
    got = {r["incident_id"]: r for r in reviews.apply_fold(base, intake.read_reviews(spark, folds)).collect()}
    assert got["a"]["severity"] == hand["severity"] and got["a"]["needs_review"] == hand["needs_review"]
