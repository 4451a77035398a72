"""What the physical plans must and must not contain at scale."""

import pytest
from pyspark.sql import functions as F

from wardlight.operators import governance, requests, store, triage, views
from wardlight.plans.catalog import PLANS

SF_DIR = "/root/testdata/sf0.001"
PYTHON = {"vector_topk", "retrieve_context", "root_cause_prompts", "root_cause_reports", "root_cause_rejects"}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def big(spark):
    """No table is small enough to be broadcast by its size, and plans are final."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    for key, value in old.items():
        spark.conf.set(key, value)


@pytest.mark.parametrize("name", [n for n in PLANS if not n.startswith("stream_")])
def test_no_pair_joins_and_no_python_rows(big, name):
    text = plan_of(PLANS[name](big, SF_DIR))
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text
    assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text
    assert name in PYTHON or "InPandas" not in text


@pytest.mark.parametrize("name", [
    "normalize_request", "redact_pii", "enforce_policies", "parse_llm_response", "parse_log_line",
    "render_prompt", "chunk_documents", "split_audit_log", "decide_escalation", "review_entries",
])
def test_row_operators_do_not_shuffle(big, name):
    assert "Exchange" not in plan_of(PLANS[name](big, SF_DIR))


@pytest.mark.parametrize("name, exchanges", [
    ("bias_by_zip", 1), ("log_anomalies", 1), ("severity_entropy", 2), ("fold_history", 1),
    ("upsert_incidents", 2), ("latency_histogram", 1), ("alert_SLOBreach", 2), ("alert_HighLLMLatency", 2),
    ("alert_PodCrashLooping", 2), ("token_cost_totals", 1),
])
def test_number_of_shuffles(big, name, exchanges):
    # the end of an evaluation is one number from an aggregate of its own
    kind = "Exchange hashpartitioning" if name.startswith("alert_") else "Exchange "
    assert plan_of(PLANS[name](big, SF_DIR)).count(kind) == exchanges


def test_triage_with_answers_at_hand_is_one_stage(big):
    rows = PLANS["normalize_request"](big, SF_DIR).withColumn("response", F.lit("{}"))
    assert "Exchange" not in plan_of(triage.triage(rows))


def test_drift_limits_before_both_shuffles(big):
    text = plan_of(PLANS["drift_check"](big, SF_DIR))
    assert text.count("50, Partial") == 4 and text.count("50, Final") == 4


def test_parse_runs_once(big):
    for name in ("parse_llm_response", "read_json_logs", "trace_incident"):
        assert plan_of(PLANS[name](big, SF_DIR)).count("from_json") == 1, name


def test_filters_and_columns_reach_the_files(big, tmp_path):
    PLANS["upsert_incidents"](big, SF_DIR).write.parquet(str(tmp_path / "i"))
    stored = big.read.parquet(str(tmp_path / "i")).withColumn("ai_severity", F.col("severity"))
    text = plan_of(governance.performance_stats(stored))
    assert "PushedFilters: [IsNotNull(human_reviewed), EqualTo(human_reviewed,true)]" in text
    assert "ReadSchema: struct<severity:string,human_reviewed:boolean,prompt_version:string>" in text
    assert "EqualTo(severity,CRITICAL)" in plan_of(views.filter_critical(stored).select("incident_id"))


def test_a_small_batch_does_not_shuffle_the_store(big):
    new = big.sql("SELECT * FROM VALUES ('1'), ('x') AS batch(incident_id)")
    stored = PLANS["upsert_incidents"](big, SF_DIR).select("incident_id")
    big.conf.set("spark.sql.autoBroadcastJoinThreshold", "1m")
    text = plan_of(requests.skip_seen(new, stored))
    assert "BroadcastHashJoin" in text and "LeftSemi" in text
    assert sorted(r[0] for r in requests.skip_seen(new, stored).collect()) == ["x"]
    big.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    assert "BroadcastHashJoin" not in plan_of(requests.skip_seen(new, stored))


def test_building_a_plan_starts_no_job(big):
    asked, stored = (PLANS[n](big, SF_DIR) for n in ("normalize_request", "filter_critical"))
    incidents = PLANS["get_incident"](big, SF_DIR).drop("requested_id", "status")
    tracker = big.sparkContext.statusTracker()
    big.sparkContext.setJobGroup("building", "plans")
    requests.skip_seen(asked, stored)
    triage.pending(asked, stored)
    views.get_incident(incidents, asked)
    assert not tracker.getJobIdsForGroup("building")
    big.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("name, partial", [
    ("fold_history", "partial_max_by"), ("apply_reviews", "partial_max_by"), ("log_anomalies", "partial_count"),
    ("latest_confidence", "partial_max"), ("alert_HighLLMLatency", "partial_count"), ("alert_groups", "partial_count"),
])
def test_hot_keys_combine_before_the_shuffle(big, name, partial):
    text = plan_of(PLANS[name](big, SF_DIR))
    assert text.rindex(partial) > text.index("Exchange hashpartitioning")


def test_a_key_with_a_third_of_all_rows(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("incident_id"),
        F.col("id").alias("n"), F.lit("v").alias("severity"))
    last = store.last_per_key(rows.repartition(8), ["n"])
    assert last.count() == 2001 and last.filter("incident_id = 'hot'").first()["n"] == 2997
