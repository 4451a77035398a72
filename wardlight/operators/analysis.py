"""From log lines to root-cause prompts, and from their answers to reports and alerts.

The model and the embedding stay outside: the vector that stands for a source's
evidence arrives as a column, the prompt leaves as one, and the answer arrives
as one again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlight.operators import alerts, answers, logs, retrieval

# The instructions of the root-cause prompt and the message that carries the evidence.
SYSTEM = """You are an Enterprise SRE AI.
            Rules: 
            1. Use ONLY provided evidence and context.
            2. Extract severity, anomaly_type, and source_ip from the provided logs.
            3. Never invent threat intel. 
            4. Distinguish FACTS from INFERENCES.
            5. Never use words like 'attack', 'malicious', 'botnet', or 'hacker' unless explicitly supported by the context.
            Confidence Rules: High (Direct evidence), Medium (Strong pattern), Low (Insufficient evidence).
            Retrieved Context: {context}"""
HUMAN = "Evidence:\n{evidence}"


def _indented(items: Column) -> Column:
    """A list of evidence as JSON with two blanks for each level; characters beyond ASCII stay as they are."""
    def text(value: Column) -> Column:
        # a JSON list of one text, without its brackets
        listed = F.to_json(F.array(value))
        return F.substring(listed, F.lit(2), F.length(listed) - 2)

    def item(r: Column) -> Column:
        return F.concat(
            F.lit('  {\n    "client_ip": '), text(r["client_ip"]), F.lit(',\n    "message": '), text(r["message"]),
            F.lit(',\n    "count": '), r["count"].cast("string"), F.lit("\n  }"))

    return F.concat(F.lit("[\n"), F.array_join(F.transform(items, item), ",\n"), F.lit("\n]"))


def source_evidence(lines: DataFrame, by: str, n: int = 3, col: str = "line") -> DataFrame:
    """Per source of log lines the top n anomalies, as ``evidence`` (a list) and ``evidence_text`` (JSON).

    Anomalies combine before the shuffle; of each source n rows are gathered.
    Lines that do not parse are left out, as is a source without any other.
    """
    parsed = logs.parse_log_line(logs.clean_lines(lines, col), col)
    counted = logs.level_score(parsed).groupBy(by, "client_ip", "message").agg(
        F.count(F.lit(1)).alias("count"), F.max("severity_score").alias("_score"))
    ranked = counted.withColumn("rank", F.row_number().over(
        Window.partitionBy(by).orderBy((F.col("count") * F.col("_score")).desc(), "client_ip", "message"))).filter(F.col("rank") <= n)
    rows = F.array_sort(F.collect_list(F.struct("rank", "client_ip", "message", "count")))
    listed = F.transform(rows, lambda r: F.struct(r["client_ip"].alias("client_ip"), r["message"].alias("message"), r["count"].alias("count")))
    return ranked.groupBy(by).agg(listed.alias("evidence")).withColumn("evidence_text", _indented(F.col("evidence")))


def root_cause_prompts(lines: DataFrame, vectors: DataFrame, chunks: DataFrame, by: str, k: int = retrieval.CONTEXT_TEXTS) -> DataFrame:
    """Per source: its evidence, the runbook context nearest to it, and both messages of the prompt.

    ``vectors`` is (source, vector) under the name ``by``, ``chunks`` as in
    ``retrieval.retrieve_context``. A source without a vector gets no context.
    """
    told = source_evidence(lines, by)
    near = retrieval.retrieve_context(vectors.select(F.col(by).alias("query_id"), "vector"), chunks, k)
    joined = told.join(near.withColumnRenamed("query_id", by), by, "left").withColumn("context", F.coalesce("context", F.lit("")))
    return joined.select(
        by, "evidence_text", "context",
        F.replace(F.lit(SYSTEM), F.lit("{context}"), F.col("context")).alias("system"),
        F.replace(F.lit(HUMAN), F.lit("{evidence}"), F.col("evidence_text")).alias("human"))


def root_cause_reports(prompts: DataFrame, replies: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
    """(reports, rejects) of the answers to prompts; ``replies`` is (incident_id, source, report).

    A report has the fields of the answer beside its source's evidence, and
    ``payload``, the notification, where its severity asks for one. Answers
    that cannot be read, or whose source has no prompt, are rejects.
    """
    known = replies.join(prompts.select(by, "evidence_text"), by, "left")
    asked, lost = known.filter(F.col("evidence_text").isNotNull()), known.filter(F.col("evidence_text").isNull())
    ok, bad = answers.report_from_json(asked)
    rejects = bad.select("incident_id", by, "report").unionByName(lost.select("incident_id", by, "report"))
    return ok.withColumn("payload", alerts.report_payload()), rejects
