"""Log, metric, retrieval and alert queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from wardlight.operators import alerts as A
from wardlight.operators import analysis as AN
from wardlight.operators import logs as L
from wardlight.operators import metrics as M
from wardlight.operators import retrieval as R
from wardlight.plans import triage_plans as TP
from wardlight.plans.base import Data, Plan
from wardlight.session import work_folder
from wardlight.sources import readers

HOUR = 3600
_PATTERN = r"^\[([^\]]+)\]\s+\[([^\]]+)\]\s+(?:\[client\s+([^\]]+)\]\s+)?(.*)$"

# ---- logs ----
_LOGS = rf"""trimmed AS (SELECT event_id, trim(line) AS line FROM fx_log_lines),
logs AS (SELECT event_id, regexp_extract(line, '{_PATTERN}', 1) AS log_ts, lower(regexp_extract(line, '{_PATTERN}', 2)) AS level,
    coalesce(nullif(regexp_extract(line, '{_PATTERN}', 3), ''), 'unknown') AS client_ip,
    trim(regexp_extract(line, '{_PATTERN}', 4)) AS message
  FROM trimmed WHERE regexp_matches(line, '{_PATTERN}')),
scored AS (SELECT *, CAST(CASE WHEN level IN ('emerg', 'alert', 'crit') THEN 100 WHEN level = 'error' THEN 80 WHEN level = 'warn' THEN 50
    WHEN level = 'notice' THEN 10 ELSE 1 END AS INT) AS severity_score FROM logs),
anomalies AS (SELECT client_ip, message, count(*) AS count, max(severity_score) AS severity_score,
    count(*) * max(severity_score) AS priority FROM scored GROUP BY client_ip, message),
top AS (SELECT * FROM anomalies ORDER BY priority DESC, client_ip, message LIMIT 3)"""


def _logs(d: Data):
    return L.parse_log_line(d.log_lines)


_SERVICE = """records AS (SELECT CAST(rtrim(line ->> 'timestamp', 'Z') AS TIMESTAMP) AS timestamp, line ->> 'level' AS level,
    line ->> 'logger' AS logger, line ->> 'message' AS message, line ->> 'module' AS module, line ->> 'func_name' AS func_name,
    line ->> 'trace_id' AS trace_id, line ->> 'incident_id' AS incident_id, line ->> 'exception' AS exception
  FROM fx_service_log_lines WHERE json_valid(line))"""


def _service(d: Data):
    return readers.parse_json_logs(d.service_log_lines)[0]


# ---- counts, cost, latency ----
_COST = "CAST(sum(prompt_tokens) AS BIGINT) * 0.000005::DOUBLE + CAST(sum(completion_tokens) AS BIGINT) * 0.000015::DOUBLE"
_HIST = "hist AS (" + " UNION ALL ".join(
    [f"SELECT '{b:g}' AS le, count(*) FILTER (duration_s <= {b}::DOUBLE) AS cumulative FROM fx_calls" for b in M.BOUNDS]
    + ["SELECT '+Inf', count(duration_s) FROM fx_calls"]
) + ")"


def quantile_sql(source: str, by: str, q: float) -> str:
    """Interpolated quantile of long bucket rows (by, le double, cum)."""
    part = f"PARTITION BY {by}" if by else ""
    cols = f"{by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""
    return f"""steps AS (SELECT *, {q}::DOUBLE * max(cum) OVER ({part}) AS rank, lag(cum, 1, 0) OVER ({part} ORDER BY le) AS under,
    lag(le, 1, 0::DOUBLE) OVER ({part} ORDER BY le) AS low FROM {source}),
quant AS (SELECT {cols}min(CASE WHEN le = 'Infinity'::DOUBLE THEN {M.BOUNDS[-1]}::DOUBLE ELSE low + (le - low) * ((rank - under) / (cum - under)) END)
    FILTER (cum >= rank AND under < rank) AS value FROM steps{group})"""


_LONG = "long AS (SELECT CASE le WHEN '+Inf' THEN 'Infinity'::DOUBLE ELSE CAST(le AS DOUBLE) END AS le, cumulative AS cum FROM hist)"

_ROUND = 6


def _rounded(df, *names):
    return df.withColumns({n: F.round(n, _ROUND) for n in names})


# ---- the grid in SQL ----
def tick_sql(ts: str = "ts", step: int = HOUR) -> str:
    return f"CAST(ceil(epoch_us({ts}) / {step * 1_000_000}) AS BIGINT) * {step}"


def rolling_sql(source: str, by: str, cols: list[str], step: int, window: int, name: str = "rolled") -> str:
    """``source`` has by, tick and cols; dense grid per series, window sums, empty windows left out."""
    key = by or "'all'"
    over = f"OVER (PARTITION BY g.k ORDER BY g.tick ROWS BETWEEN {window // step - 1} PRECEDING AND CURRENT ROW)"
    sums = ", ".join(f"sum(coalesce(s.{c}, 0)) {over} AS {c}" for c in cols)
    return f"""spans AS (SELECT {key} AS k, min(tick) AS lo, least(max(tick) + {window - step}, (SELECT max(tick) FROM {source})) AS hi
  FROM {source} GROUP BY 1),
grid AS (SELECT k, unnest(generate_series(lo, hi, {step})) AS tick FROM spans),
{name} AS (SELECT g.k, g.tick, {sums}
  FROM grid g LEFT JOIN {source} s ON s.tick = g.tick AND {'s.' + by if by else key} = g.k
  QUALIFY count(s.tick) {over} > 0)"""


def counter_sql(samples: str, by: str, step: int = HOUR) -> str:
    """Growth per (series, tick) from the differences of consecutive samples."""
    return f"""diffs AS (SELECT {by}, {tick_sql(step=step)} AS tick, value,
    lag(value) OVER (PARTITION BY {by} ORDER BY ts, value) AS prior FROM {samples}),
grown AS (SELECT {by}, tick, sum(CASE WHEN value >= prior THEN value - prior WHEN value < prior THEN value ELSE 0 END) AS growth
  FROM diffs GROUP BY ALL)"""


def gauge_sql(samples: str, by: str, value: str, step: int, lookback: int) -> str:
    """Last value per tick, carried until it is older than the lookback."""
    return f"""lastv AS (SELECT {by} AS k, {tick_sql(step=step)} AS tick, max_by({value}, (ts, {value})) AS v FROM {samples} GROUP BY 1, 2),
nextv AS (SELECT *, lead(tick) OVER (PARTITION BY k ORDER BY tick) AS nxt FROM lastv),
rolled AS (SELECT k, v, unnest(generate_series(tick, greatest(tick, least(coalesce(nxt - {step}, (SELECT max(tick) FROM lastv)), tick + {lookback - step})), {step})) AS tick
  FROM nextv)"""


def runs_sql(source: str, value: str, test: str, hold: int, step: int = HOUR) -> str:
    """Runs of ticks of ``source`` (k, tick) where ``test`` holds long enough."""
    return f"""conds AS (SELECT k, tick, {value} AS value, tick = (SELECT max(tick) FROM {source}) AS is_last FROM {source}),
firing AS (SELECT *, tick - {step} * row_number() OVER (PARTITION BY k ORDER BY tick) AS run FROM conds WHERE {test}),
runs AS (SELECT k, min(tick) AS since, max(tick) AS until, bool_or(is_last) AS still, max_by(value, tick) AS value FROM firing
  GROUP BY k, run HAVING max(tick) - min(tick) >= {hold})"""


def span_sql(hold: int, step: int = HOUR) -> str:
    return f"""make_timestamp(since * 1000000) AS since, make_timestamp((since + {hold}) * 1000000) AS fires_at,
  CASE WHEN NOT still THEN make_timestamp((until + {step}) * 1000000) END AS resolved_at"""


# What the rules must say, spelled out once more for the SQL.
_SAID = {
    "HighLLMLatency": ("critical", "LLM  Latency is too high", "P95 latency is {value}s, which is above the 5s threshold for 2 minutes."),
    "LowClassificationConfidence": ("warning", "Classification confidence dropped below 0.8",
                                    "AI model classification confidence has dropped below acceptable threshold. Current confidence: {value}."),
    "HighErrorRate": ("critical", "High Error Rate Detected", "Error rate is {value}%, exceeding the 5% limit."),
    "PodCrashLooping": ("warning", "Pod is crash looping", "Pod {pod} has restarted more than 3 times in the last 15 minutes."),
    "HighCPUUsage": ("warning", "CPU Usage is high", "CPU usage is above than 80% for more than 2 minutes"),
    "HighMemoryUsage": ("warning", "High memory usage", "Memory usage above 500MB on {instance}."),
    "SLOBreach": ("critical", "SLO Breach", "Availability is less than 99.9% for more than 5 mins"),
    "HighTokenUsage": ("warning", "High token usage", "Token usage is high for more than 3 mins."),
    "LLMHighErrorRate": ("critical", "LLM high error rate", "Error rate of LLM is {value}%, exceeding the 10% limit."),
}


def alert_sql(source: str, value: str, test: str, rule: str, hold: int, labels: dict[str, str], step: int = HOUR) -> str:
    """Runs of ``test`` over (k, tick) rows of ``source`` as alert rows."""
    severity, summary, description = _SAID[rule]
    text = "'" + description.replace("'", "''") + "'"
    for name, expr in labels.items():
        text = f"replace({text}, '{{{name}}}', CAST({expr} AS STRING))"
    text = f"replace({text}, '{{value}}', regexp_replace(CAST(round(CAST(value AS DOUBLE), {_ROUND}) AS STRING), '\\.0$', ''))"
    named = "".join(f"{expr} AS {name}, " for name, expr in labels.items())
    return f"""{runs_sql(source, value, test, hold, step)}
SELECT '{rule}' AS alertname, '{severity}' AS severity, {named}{span_sql(hold, step)},
  round(CAST(value AS DOUBLE), {_ROUND}) AS value, '{summary}' AS summary, {text} AS description FROM runs"""


GRID = {"step": HOUR, "hold": "2h"}
_HOLD = 2 * HOUR
_SIX = 6 * HOUR


def _bucket_slices(by: str) -> str:
    counts = ", ".join(f"count(*) FILTER (duration_s <= {b}::DOUBLE) AS b{i}" for i, b in enumerate(M.BOUNDS))
    return f"slices AS (SELECT {by}, {tick_sql()} AS tick, {counts}, count(duration_s) AS b{len(M.BOUNDS)} FROM fx_calls GROUP BY ALL)"


def _bucket_quantile(q: float) -> str:
    """Per row of ``rolled``: the interpolated quantile as a CASE over the buckets."""
    total = f"b{len(M.BOUNDS)}"
    arms, low, under = [], 0.0, "0"
    for i, b in enumerate(M.BOUNDS):
        arms.append(f"WHEN b{i} >= {q}::DOUBLE * {total} THEN {low}::DOUBLE + ({b}::DOUBLE - {low}::DOUBLE)"
                    f" * (({q}::DOUBLE * {total} - {under}) / (b{i} - {under}))")
        low, under = b, f"b{i}"
    return f"CASE WHEN {total} = 0 THEN NULL {' '.join(arms)} ELSE {M.BOUNDS[-1]}::DOUBLE END"


def shares_sql(by: str, where: str = "") -> str:
    """Share of failed calls in the trailing six hours, per series and tick."""
    key = f"{by}, " if by else ""
    return f"""slices AS (SELECT {key}{tick_sql()} AS tick, count(*) AS total, count(*) FILTER (status >= 500) AS bad
  FROM fx_calls {where} GROUP BY ALL),
{rolling_sql('slices', by, ['total', 'bad'], HOUR, _SIX)},
shares AS (SELECT k, tick, CASE WHEN total > 0 THEN bad / total END AS share FROM rolled)"""


_SHARES = {by: shares_sql(by) for by in ("", "instance")}


def _alert_out(df):
    return df.withColumn("value", F.round("value", _ROUND))


def _events_sql(amount: str) -> str:
    return (f"slices AS (SELECT instance, {tick_sql()} AS tick, {amount} AS events FROM fx_calls GROUP BY ALL),"
            f" {rolling_sql('slices', 'instance', ['events'], HOUR, _SIX)}")


# a series in SQL: its labels in the order of their names, without empty ones
_SERIES = """concat_ws(',', CASE WHEN container <> '' THEN 'container=' || container END, CASE WHEN instance <> '' THEN 'instance=' || instance END,
    CASE WHEN job <> '' THEN 'job=' || job END, CASE WHEN namespace <> '' THEN 'namespace=' || namespace END,
    CASE WHEN pod <> '' THEN 'pod=' || pod END)"""


def _named(name: str) -> str:
    return f"samples AS (SELECT ts, value, {_SERIES} AS series FROM fx_metrics WHERE name = '{name}')"


def _label(name: str) -> str:
    return f"regexp_extract(k, '{name}=([^,]*)', 1)"


_OF_PROCESS = {"series": "k", "namespace": _label("namespace"), "instance": _label("instance"), "job": _label("job")}
_OF_POD = {"series": "k", "namespace": _label("namespace"), "pod": _label("pod"), "container": _label("container")}

_CPU = f"""{_named('process_cpu_seconds_total')}, {counter_sql('samples', 'series')},
{rolling_sql('grown', 'series', ['growth'], HOUR, _SIX)}"""
_PODS = f"""{_named('kube_pod_container_status_restarts_total')}, {counter_sql('samples', 'series')},
{rolling_sql('grown', 'series', ['growth'], HOUR, _SIX)}"""


def _samples(d: Data):
    """The samples in the shape of a scrape: labels as a map."""
    names = ("namespace", "instance", "pod", "container", "job")
    pairs = [x for n in names for x in (F.lit(n), F.col(n))]
    return d.metrics.select("ts", "name", F.map_filter(F.create_map(*pairs), lambda k, v: v != "").alias("labels"), "value")


def _read_metrics(d: Data):
    """The samples written, and read with the reader's schema."""
    folder = work_folder(d.spark, "metrics")
    _samples(d).write.parquet(folder)
    return readers.read_metrics(d.spark, folder).select("ts", "name", "value", *[
        F.coalesce(F.try_element_at("labels", F.lit(n)), F.lit("")).alias(n) for n in ("namespace", "instance", "pod", "container", "job")])


ALERT_PLANS = [
    Plan("alert_HighLLMLatency",
         lambda d: _alert_out(A.alert_HighLLMLatency(d.calls, threshold=2.3, window=_SIX, **GRID)),
         f"""WITH {_bucket_slices('instance')},
{rolling_sql('slices', 'instance', [f'b{i}' for i in range(len(M.BOUNDS) + 1)], HOUR, _SIX)},
q AS (SELECT k, tick, {_bucket_quantile(0.95)} AS p FROM rolled),
{alert_sql('q', 'p', 'value > 2.3::DOUBLE', 'HighLLMLatency', _HOLD, {'instance': 'k'})}"""),
    Plan("alert_LowClassificationConfidence",
         lambda d: _alert_out(A.alert_LowClassificationConfidence(d.calls, lookback="1 day", **GRID)),
         f"""WITH {gauge_sql('fx_calls', "instance || '/' || severity", 'confidence', HOUR, 24 * HOUR)},
{alert_sql('rolled', 'v', 'value < 0.8::DOUBLE', 'LowClassificationConfidence', _HOLD,
           {'instance': "CAST(split_part(k, '/', 1) AS BIGINT)", 'label': "split_part(k, '/', 2)"})}"""),
    Plan("alert_HighErrorRate",
         lambda d: _alert_out(A.alert_HighErrorRate(d.calls, threshold=0.2, window=_SIX, **GRID)),
         f"WITH {_SHARES['']}, {alert_sql('shares', 'share', 'value > 0.2::DOUBLE', 'HighErrorRate', _HOLD, {})}"),
    Plan("alert_SLOBreach",
         lambda d: _alert_out(A.alert_SLOBreach(d.calls, target=0.8, window=_SIX, **GRID)),
         f"""WITH {_SHARES['instance']}, {alert_sql('shares', '1 - share', 'value < 0.8::DOUBLE', 'SLOBreach', _HOLD,
                                                   {'instance': 'k'})}"""),
    Plan("alert_LLMHighErrorRate",
         lambda d: _alert_out(A.alert_LLMHighErrorRate(d.calls, threshold=0.22, window=_SIX, **GRID)),
         f"""WITH {_SHARES['instance']}, {alert_sql('shares', 'share', 'value > 0.22::DOUBLE', 'LLMHighErrorRate', _HOLD,
                                                   {'instance': 'k'})}"""),
    Plan("alert_HighTokenUsage",
         lambda d: _alert_out(A.alert_HighTokenUsage(d.calls, threshold=0.0013, window=_SIX, **GRID)),
         f"""WITH {_events_sql('count(*)')}, {alert_sql('rolled', f'events / {_SIX}::DOUBLE', 'value > 0.0013::DOUBLE',
                                                      'HighTokenUsage', _HOLD, {'instance': 'k'})}"""),
    Plan("alert_HighTokenUsage_tokens",
         lambda d: _alert_out(A.alert_HighTokenUsage(d.calls, threshold=0.45, window=_SIX, count_tokens=True, **GRID)),
         f"""WITH {_events_sql('sum(prompt_tokens + completion_tokens)')}, {alert_sql(
             'rolled', f'events / {_SIX}::DOUBLE', 'value > 0.45::DOUBLE', 'HighTokenUsage', _HOLD, {'instance': 'k'})}"""),
    Plan("alert_PodCrashLooping",
         lambda d: _alert_out(A.alert_PodCrashLooping(_samples(d), threshold=3, window=_SIX, **GRID)),
         f"WITH {_PODS}, {alert_sql('rolled', 'growth', 'value > 3', 'PodCrashLooping', _HOLD, _OF_POD)}"),
    Plan("alert_HighCPUUsage",
         lambda d: _alert_out(A.alert_HighCPUUsage(_samples(d), threshold=0.97, window=_SIX, **GRID)),
         f"""WITH {_CPU}, {alert_sql('rolled', f'growth / {_SIX}::DOUBLE', 'value > 0.97::DOUBLE', 'HighCPUUsage', _HOLD,
                                    _OF_PROCESS)}"""),
    Plan("alert_HighMemoryUsage",
         lambda d: _alert_out(A.alert_HighMemoryUsage(d.metrics, threshold=430_000_000, lookback="1 day", **GRID)),
         f"""WITH {_named('process_resident_memory_bytes')},
{gauge_sql('samples', 'series', 'value', HOUR, 24 * HOUR)},
{alert_sql('rolled', 'v', 'value > 430000000', 'HighMemoryUsage', _HOLD, _OF_PROCESS)}"""),
]


def all_alerts(d: Data):
    """Alerts of both severities over the whole call and sample tables, one shape."""
    rows = [
        A.alert_SLOBreach(d.calls, target=0.8, window=_SIX, **GRID).withColumn("instance", F.col("instance").cast("string")),
        A.alert_HighTokenUsage(d.calls, threshold=0.0013, window=_SIX, **GRID).withColumn("instance", F.col("instance").cast("string")),
        A.alert_PodCrashLooping(_samples(d), threshold=3, window=_SIX, **GRID).drop("series", "container"),
        A.alert_HighCPUUsage(_samples(d), threshold=0.97, window=_SIX, **GRID).drop("series", "job"),
    ]
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), rows)


_COMMON = "alertname, severity, since, fires_at, resolved_at, summary, description"


def _part(name: str, **labels: str) -> str:
    sql = next(p for p in ALERT_PLANS if p.name == name).sql
    shown = ", ".join(f"CAST({labels.get(n, 'NULL')} AS STRING) AS {n}" for n in ("instance", "namespace", "pod"))
    return f"SELECT {_COMMON}, {shown} FROM ({sql})"


_BOTH = " UNION ALL ".join((
    _part("alert_SLOBreach", instance="instance"), _part("alert_HighTokenUsage", instance="instance"),
    _part("alert_PodCrashLooping", namespace="namespace", pod="pod"), _part("alert_HighCPUUsage", namespace="namespace", instance="instance"),
))


def _line(label: str, value: str, mark: str = "") -> str:
    """A line of an alert's text that is left out when the alert has no such label."""
    return f"CASE WHEN coalesce({value}, '') <> '' THEN chr(10) || '*{label}:* {mark}' || {value} || '{mark}' ELSE '' END"


_LINES = f"""'*Alert:* ' || alertname || chr(10) || '*Namespace:* ' || coalesce(namespace, '') || chr(10) || '*Severity:* ' || severity || chr(10)
  || '*Summary:* ' || summary || chr(10) || '*Description:* ' || description || {_line('Instance', 'instance', '`')} || {_line('Pod', 'pod', '`')}"""
_DEFAULT_LINES = f"""'*Alert:* ' || alertname || chr(10) || '*Severity:* ' || severity || chr(10) || '*Summary:* ' || summary || chr(10)
  || '*Description:* ' || description || {_line('Instance', 'instance')} || {_line('Pod', 'pod')} || {_line('Namespace', 'namespace')}"""


def _routing(place: str) -> str:
    return f"""CASE severity WHEN 'critical' THEN 'slack-critical' ELSE 'slack-alerts' END AS receiver,
  CASE severity WHEN 'critical' THEN ':rotating_light: CRITICAL' ELSE ':warning:' END || ' [{place}] ' || alertname AS title"""


def groups_sql(place: str) -> str:
    """Every change of every group: how many alerts fire or resolve then, and how many fire from then on."""
    return f"""WITH alerts AS ({_BOTH}),
moments AS (SELECT alertname, severity, fires_at AS at FROM alerts UNION SELECT alertname, severity, resolved_at FROM alerts WHERE resolved_at IS NOT NULL)
SELECT m.alertname, m.severity, m.at, {_routing(place).replace('severity', 'm.severity').replace('alertname', 'm.alertname')},
  count(*) FILTER (a.fires_at = m.at) AS fired, count(*) FILTER (a.resolved_at = m.at) AS resolved,
  count(*) FILTER (a.fires_at <= m.at AND (a.resolved_at IS NULL OR a.resolved_at > m.at)) AS firing
FROM moments m JOIN alerts a ON a.alertname = m.alertname AND a.severity = m.severity GROUP BY m.alertname, m.severity, m.at"""


def lines_sql(place: str, lines: str) -> str:
    return f"WITH alerts AS ({_BOTH}) SELECT alertname, severity, {_routing(place)}, since, fires_at, resolved_at, {lines} AS text FROM alerts"


def text_sql(lines: str) -> str:
    return f"WITH alerts AS ({_BOTH}) SELECT alertname, instance, namespace, pod, since, {lines} AS text FROM alerts"


_TEXT_COLUMNS = ("alertname", "instance", "namespace", "pod", "since", "text")


def _conditions(d: Data):
    shares = A.error_share(d.calls, _SIX, HOUR, ("instance",))
    return shares.select("instance", "tick", F.col("share").alias("value"), (F.col("share") > 0.2).alias("firing"))


def _queries(d: Data):
    """One question per label: the label's first vector."""
    return d.table("embeddings").groupBy(F.col("label").alias("query_id")).agg(
        F.min_by("embedding", "vec_id").cast("array<double>").alias("vector"))


_QUERIES = "queries AS (SELECT label AS query_id, arg_min(embedding, vec_id)::DOUBLE[] AS vector FROM embeddings GROUP BY label)"


def _vectors(d: Data):
    return d.table("embeddings").select(
        F.col("vec_id").alias("chunk_id"), F.col("embedding").cast("array<double>").alias("vector"))


def _nearest_out(df):
    return df.withColumn("distance", F.round("distance", _ROUND))


def nearest_sql(k: int) -> str:
    return f"""pairs AS (SELECT query_id, vec_id AS chunk_id, list_distance(vector, embedding::DOUBLE[]) AS d FROM queries, embeddings),
near AS (SELECT query_id, chunk_id, d, CAST(row_number() OVER (PARTITION BY query_id ORDER BY d, chunk_id) AS INT) AS rank FROM pairs
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY d, chunk_id) <= {k})"""


def _context(d: Data):
    """The runbook text of a vector is the document of the same number."""
    texts = d.table("documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("chunk"))
    chunks = _vectors(d).join(texts, "chunk_id")
    return R.retrieve_context(_queries(d), chunks)


def _kinds(d: Data):
    return d.calls.withColumn("kind", F.when(F.col("event_id") % 2 == 0, F.lit("http")).otherwise(F.lit("llm")))


def _prompts(d: Data):
    """Log lines of seven sources, each with the vector of the label of its number."""
    texts = d.table("documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("chunk"))
    vectors = _queries(d).select(F.col("query_id").cast("string").alias("source"), "vector")
    lines = d.log_lines.select("line", (F.col("event_id") % 7).cast("string").alias("source"))
    return AN.root_cause_prompts(lines, vectors, _vectors(d).join(texts, "chunk_id"), "source")


def _replies(d: Data):
    return d.reports.withColumn("source", (F.col("incident_id").cast("long") % 9).cast("string"))


_JSON_LINE = """'  {' || chr(10) || '    "client_ip": "' || client_ip || '",' || chr(10) || '    "message": "' || message || '",' || chr(10)
  || '    "count": ' || count || chr(10) || '  }'"""
_TOLD = f"""{_LOGS}, per AS (SELECT CAST(event_id % 7 AS STRING) AS source, client_ip, message, count(*) AS count, max(severity_score) AS score
  FROM scored GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY count * score DESC, client_ip, message) AS place FROM per),
told AS (SELECT source, '[' || chr(10) || string_agg({_JSON_LINE}, ',' || chr(10) ORDER BY place) || chr(10) || ']' AS evidence_text
  FROM best WHERE place <= 3 GROUP BY source)"""
_SYSTEM_TEXT = AN.SYSTEM.replace("'", "''")
_PROMPT_SQL = f"""WITH {_TOLD}, {_QUERIES}, vecs AS (SELECT e.* FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id),
{nearest_sql(2).replace('queries, embeddings', 'queries, vecs')},
contexts AS (SELECT CAST(query_id AS STRING) AS source, string_agg(text, chr(10) ORDER BY rank) AS context FROM near
  JOIN documents ON doc_id = chunk_id GROUP BY query_id)
SELECT t.source, evidence_text, coalesce(context, '') AS context, replace('{_SYSTEM_TEXT}', '{{context}}', coalesce(context, '')) AS system,
  'Evidence:' || chr(10) || evidence_text AS human FROM told t LEFT JOIN contexts c ON c.source = t.source"""
_REPLY_SQL = f"""WITH {_TOLD}, {TP._REPORT}
SELECT r.incident_id, t.source, severity, anomaly_type, source_ip, root_cause, confidence, evidence_text,
  CASE WHEN severity IN ('High', 'Critical') THEN '{{"blocks":[{{"type":"header","text":{{"type":"plain_text","text":"🚨 '
  || upper(severity) || ' Incident Detected","emoji":true}}}},{{"type":"section","fields":[{{"type":"mrkdwn","text":"*Type:*\\n'
  || anomaly_type || '"}},{{"type":"mrkdwn","text":"*Source IP:*\\n`' || source_ip
  || '`"}}]}},{{"type":"section","text":{{"type":"mrkdwn","text":"*Recommended Action:*\\n[''' || a0 || ''', ''' || a1 || ''']"}}}}]}}' END AS payload
FROM reports r JOIN told t ON t.source = CAST(CAST(r.incident_id AS BIGINT) % 9 AS STRING)"""
_REFUSED_SQL = f"""WITH {_TOLD}, {TP._REPORT} SELECT incident_id, CAST(CAST(incident_id AS BIGINT) % 9 AS STRING) AS source, report FROM fx_reports
WHERE incident_id NOT IN (SELECT incident_id FROM reports) OR CAST(CAST(incident_id AS BIGINT) % 9 AS STRING) NOT IN (SELECT source FROM told)"""


def _cut_sql(name: str, source: str, sep: str) -> str:
    """Pieces of the rows (doc_id, off, x) of ``source``, cut before a separator, with the place of the row as ``node``."""
    return f"""{name}_i AS (SELECT doc_id, off AS node, string_split(x, {sep}) AS parts, unnest(generate_series(1, len(string_split(x, {sep})))) AS i FROM {source}),
{name}_p AS (SELECT doc_id, node, i, CASE WHEN i = 1 THEN '' ELSE {sep} END || parts[i] AS x FROM {name}_i),
{name} AS (SELECT doc_id, node, x, CAST(node + sum(length(x)) OVER (PARTITION BY doc_id, node ORDER BY i) - length(x) AS BIGINT) AS off FROM {name}_p),
{name}_long AS (SELECT doc_id, off, x FROM {name} WHERE length(x) >= 1000)"""


def _atoms_sql(name: str, level: int) -> str:
    return f"SELECT doc_id, {level} AS level, node, off, length(x) AS n FROM {name} WHERE x <> '' AND length(x) < 1000"


# chunks of 1,000 characters with 100 carried on: from each start the last end in reach, then the first start that leaves room
_SPLIT_SQL = f"""WITH RECURSIVE whole AS (SELECT doc_id, CAST(0 AS BIGINT) AS off, text AS x FROM documents WHERE length(text) > 0),
{_cut_sql('paragraphs', 'whole', 'chr(10) || chr(10)')},
{_cut_sql('rows_of', 'paragraphs_long', 'chr(10)')},
{_cut_sql('words', 'rows_of_long', "' '")},
letters AS (SELECT doc_id, off AS node, unnest(range(length(x))) AS k FROM words_long),
atoms AS ({_atoms_sql('paragraphs', 1)} UNION ALL {_atoms_sql('rows_of', 2)} UNION ALL {_atoms_sql('words', 3)}
  UNION ALL SELECT doc_id, 4, node, node + k, 1 FROM letters),
marked AS (SELECT *, coalesce((level, node) <> lag((level, node)) OVER (PARTITION BY doc_id ORDER BY off), true) AS opens FROM atoms),
numbered AS (SELECT *, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY off) AS grp FROM marked),
groups AS (SELECT doc_id, grp, list(off ORDER BY off) AS starts, list(off + n ORDER BY off) AS ends, min(off) AS lo, max(off + n) AS hi
  FROM numbered GROUP BY doc_id, grp),
spans AS (SELECT doc_id, grp, starts, ends, hi, lo AS s, list_max(list_filter(ends, lambda x: x <= lo + 1000)) AS e FROM groups
  UNION ALL SELECT doc_id, grp, starts, ends, hi, b, list_max(list_filter(ends, lambda x: x <= b + 1000)) FROM (SELECT doc_id, grp, starts, ends, hi,
    list_min(list_filter(starts, lambda x: x >= greatest(e - 100, list_min(list_filter(ends, lambda y: y > e)) - 1000))) AS b FROM spans WHERE e < hi)),
texts AS (SELECT d.doc_id, grp, s, regexp_replace(substring(text, s + 1, e - s), '^\\s+|\\s+$', '', 'g') AS chunk
  FROM spans JOIN documents d ON d.doc_id = spans.doc_id)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY grp, s) - 1 AS INT) AS chunk_no, chunk FROM texts WHERE chunk <> ''"""


PLANS = [
    # ---- logs ----
    Plan("read_logs", lambda d: L.clean_lines(d.log_lines), "SELECT * FROM fx_log_lines"),
    Plan("parse_log_line", _logs, f"WITH {_LOGS} SELECT event_id, log_ts, level, client_ip, message FROM logs"),
    Plan("level_score", lambda d: L.level_score(_logs(d)).select("event_id", "level", "severity_score"),
         f"WITH {_LOGS} SELECT event_id, level, severity_score FROM scored"),
    Plan("log_anomalies", lambda d: L.log_anomalies(_logs(d)), f"WITH {_LOGS} SELECT * FROM anomalies"),
    Plan("top_anomalies", lambda d: L.top_anomalies(_logs(d)), f"WITH {_LOGS} SELECT client_ip, message, count FROM top"),
    Plan("diagnostic_evidence", lambda d: L.diagnostic_evidence(d.log_lines),
         f"""WITH {_LOGS} SELECT '[' || string_agg('{{"client_ip":"' || client_ip || '","message":"' || message || '","count":' || count || '}}', ','
  ORDER BY priority DESC, client_ip, message) || ']' AS evidence FROM top"""),
    Plan("read_json_logs", _service, f"WITH {_SERVICE} SELECT * FROM records"),
    Plan("read_json_logs_rejects", lambda d: readers.parse_json_logs(d.service_log_lines)[1],
         "SELECT line FROM fx_service_log_lines WHERE NOT json_valid(line)"),
    Plan("trace_incident", lambda d: L.trace_incident(_service(d)),
         f"WITH {_SERVICE} SELECT * FROM records WHERE incident_id IS NOT NULL"),
    Plan("trace_summary", lambda d: L.trace_summary(_service(d)),
         f"""WITH {_SERVICE} SELECT incident_id, min(timestamp) AS first_seen, max(timestamp) AS last_seen,
  count(DISTINCT logger) AS services, count(*) AS entries, count(*) FILTER (level = 'ERROR') AS errors,
  max_by(message, (timestamp, logger, message)) AS last_message FROM records WHERE incident_id IS NOT NULL GROUP BY incident_id"""),
    # ---- retrieval ----
    Plan("chunk_documents", lambda d: R.chunk_documents(d.table("documents").select("doc_id", "text")),
         """WITH t AS (SELECT doc_id, text, greatest(1, CAST(ceil((length(text) - 100) / 900) AS INT)) AS n FROM documents WHERE length(text) > 0),
g AS (SELECT doc_id, text, unnest(range(n)) AS i FROM t)
SELECT doc_id, CAST(i AS INT) AS chunk_no, substring(text, CAST(i * 900 + 1 AS BIGINT), 1000) AS chunk FROM g"""),
    Plan("root_cause_prompts", _prompts, _PROMPT_SQL),
    Plan("root_cause_reports", lambda d: AN.root_cause_reports(_prompts(d), _replies(d), "source")[0].drop("evidence", "recommended_actions"), _REPLY_SQL),
    Plan("root_cause_rejects", lambda d: AN.root_cause_reports(_prompts(d), _replies(d), "source")[1], _REFUSED_SQL),
    Plan("split_documents", lambda d: R.split_documents(d.table("documents").select("doc_id", "text")), _SPLIT_SQL),
    Plan("vector_topk", lambda d: _nearest_out(R.vector_topk(_queries(d), _vectors(d))),
         f"WITH {_QUERIES}, {nearest_sql(2)} SELECT query_id, chunk_id, round(d, 6) AS distance, rank FROM near"),
    Plan("retrieve_context", _context,
         f"""WITH {_QUERIES}, vecs AS (SELECT e.* FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id),
{nearest_sql(2).replace('queries, embeddings', 'queries, vecs')}
SELECT query_id, string_agg(text, chr(10) ORDER BY rank) AS context FROM near JOIN documents ON doc_id = chunk_id GROUP BY query_id"""),
    # ---- metrics ----
    Plan("read_metrics", _read_metrics, "SELECT ts, name, value, namespace, instance, pod, container, job FROM fx_metrics"),
    Plan("severity_distribution", lambda d: M.severity_distribution(d.incidents),
         "SELECT ai_severity AS severity, count(*) AS incidents FROM fx_incidents GROUP BY 1"),
    Plan("severity_entropy", lambda d: _rounded(M.severity_entropy(d.incidents), "entropy"),
         f"""WITH c AS (SELECT ai_severity, count(*) AS n FROM fx_incidents WHERE ai_severity IN ('LOW', 'MEDIUM', 'HIGH', 'CRITICAL') GROUP BY 1),
p AS (SELECT n, n / sum(n) OVER () AS p FROM c)
SELECT CAST(sum(n) AS BIGINT) AS incidents, round(-sum(p * ln(p)), {_ROUND}) AS entropy FROM p"""),
    Plan("token_cost_totals", lambda d: _rounded(M.token_cost_totals(d.calls), "cost_usd"),
         f"""SELECT CAST(sum(prompt_tokens) AS BIGINT) AS input_tokens, CAST(sum(completion_tokens) AS BIGINT) AS output_tokens,
  count(*) AS calls, count(*) FILTER (status >= 500) AS errors, CAST(sum(retries) AS BIGINT) AS retries, round({_COST}, {_ROUND}) AS cost_usd FROM fx_calls"""),
    Plan("cost_rollup",
         lambda d: _rounded(M.cost_rollup(d.calls, ["instance"]), "cost_usd", "cost_per_request", "cost_per_second", "cost_per_day"),
         f"""WITH s AS (SELECT instance, count(*) AS calls, {_COST} AS c, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0::DOUBLE AS seconds
  FROM fx_calls GROUP BY instance)
SELECT instance, calls, round(c, 6) AS cost_usd, round(c / calls, 6) AS cost_per_request, round(c / seconds, 6) AS cost_per_second,
  round(c / seconds * 86400, 6) AS cost_per_day FROM s"""),
    Plan("request_counts", lambda d: M.request_counts(d.calls),
         """SELECT instance, count(*) AS requests, count(*) FILTER (status < 500) AS db_connections FROM fx_calls GROUP BY instance"""),
    Plan("latency_histogram", lambda d: M.latency_histogram(d.calls), f"WITH {_HIST} SELECT * FROM hist"),
    Plan("histogram_quantile",
         lambda d: _rounded(M.histogram_quantile(M.latency_histogram(d.calls)), "quantile"),
         f"WITH {_HIST}, {_LONG}, {quantile_sql('long', '', 0.95)} SELECT round(value, 6) AS quantile FROM quant"),
    Plan("latency_quantile",
         lambda d: _rounded(M.latency_quantile(d.calls, by=["instance"]), "quantile"),
         f"""WITH b AS (SELECT unnest([{', '.join(f"{b}::DOUBLE" for b in M.BOUNDS)}, 'Infinity'::DOUBLE]) AS le),
long AS (SELECT instance, le, count(*) FILTER (duration_s <= le) AS cum FROM fx_calls, b GROUP BY ALL),
{quantile_sql('long', 'instance', 0.95)}
SELECT q.instance, (SELECT count(*) FROM fx_calls c WHERE c.instance = q.instance) AS observations, round(value, 6) AS quantile FROM quant q"""),
    Plan("latest_confidence", lambda d: M.latest_confidence(d.calls),
         "SELECT severity, max_by(confidence, (ts, confidence)) AS confidence FROM fx_calls GROUP BY severity"),
    Plan("severity_over_time", lambda d: M.severity_over_time(d.calls),
         "SELECT date_trunc('hour', ts)::TIMESTAMP AS bucket_start, severity, count(*) AS incidents FROM fx_calls GROUP BY ALL"),
    Plan("availability", lambda d: _rounded(M.availability(d.calls), "availability"),
         """SELECT date_trunc('hour', ts)::TIMESTAMP AS bucket_start, count(*) AS requests,
  round(count(*) FILTER (status < 500) / count(*), 6) AS availability FROM fx_calls GROUP BY ALL"""),
    Plan("usage_over_time", lambda d: _rounded(M.usage_over_time(d.calls, by=["instance"]), "cost_usd"),
         f"""SELECT date_trunc('hour', ts)::TIMESTAMP AS bucket_start, instance, CAST(sum(prompt_tokens) AS BIGINT) AS input_tokens,
  CAST(sum(completion_tokens) AS BIGINT) AS output_tokens, count(*) AS calls, count(*) FILTER (status >= 500) AS errors,
  CAST(sum(retries) AS BIGINT) AS retries, round({_COST}, {_ROUND}) AS cost_usd FROM fx_calls GROUP BY 1, 2"""),
    Plan("latency_over_time", lambda d: _rounded(M.latency_over_time(_kinds(d)), "quantile"),
         f"""WITH k AS (SELECT date_trunc('hour', ts)::TIMESTAMP AS bucket_start, CASE event_id % 2 WHEN 0 THEN 'http' ELSE 'llm' END AS kind, duration_s FROM fx_calls),
b AS (SELECT unnest([{', '.join(f"{b}::DOUBLE" for b in M.BOUNDS)}, 'Infinity'::DOUBLE]) AS le),
long AS (SELECT bucket_start, kind, le, count(*) FILTER (duration_s <= le) AS cum FROM k, b GROUP BY ALL),
{quantile_sql('long', 'bucket_start, kind', 0.95)},
seen AS (SELECT bucket_start, kind, count(duration_s) AS observations FROM k GROUP BY 1, 2)
SELECT q.bucket_start, q.kind, observations, round(value, 6) AS quantile FROM quant q JOIN seen s ON s.bucket_start = q.bucket_start AND s.kind = q.kind"""),
    Plan("entropy_over_time", lambda d: _rounded(M.entropy_over_time(d.calls), "entropy"),
         f"""WITH c AS (SELECT date_trunc('hour', ts)::TIMESTAMP AS bucket_start, severity, count(*) AS n FROM fx_calls GROUP BY 1, 2),
p AS (SELECT bucket_start, n, n / sum(n) OVER (PARTITION BY bucket_start) AS p FROM c)
SELECT bucket_start, CAST(sum(n) AS BIGINT) AS incidents, round(-sum(p * ln(p)), {_ROUND}) AS entropy FROM p GROUP BY 1"""),
    Plan("rate", lambda d: _rounded(M.rate(A.samples_of(_samples(d), A.CPU_SECONDS), _SIX, HOUR, ["series"]), "rate"),
         f"WITH {_CPU} SELECT k AS series, tick, round(growth / {_SIX}::DOUBLE, 6) AS rate FROM rolled"),
    Plan("increase", lambda d: _rounded(M.increase(A.samples_of(_samples(d), A.RESTARTS), _SIX, HOUR, ["series"]), "increase"),
         f"WITH {_PODS} SELECT k AS series, tick, growth AS increase FROM rolled"),
    Plan("event_rate", lambda d: _rounded(M.event_rate(d.calls, _SIX, HOUR), "rate"),
         f"""WITH {_events_sql('count(*)')} SELECT k AS instance, tick, CAST(events AS BIGINT) AS events,
  round(events / {_SIX}::DOUBLE, 6) AS rate FROM rolled"""),
    Plan("sustained", lambda d: _rounded(A.sustained(_conditions(d), "2h", ["instance"], HOUR), "value"),
         f"""WITH {_SHARES['instance']}, {runs_sql('shares', 'share', 'value > 0.2::DOUBLE', _HOLD)}
SELECT k AS instance, {span_sql(_HOLD)}, round(value, {_ROUND}) AS value FROM runs"""),
    Plan("signal_anomalies",
         lambda d: _rounded(M.signal_anomalies(d.calls, z=2.0), "traffic_z", "tokens_z", "latency_z"),
         """WITH seen AS (SELECT date_trunc('hour', ts)::TIMESTAMP AS bucket_start, count(*)::DOUBLE AS traffic,
  sum(prompt_tokens + completion_tokens)::DOUBLE AS tokens,
  CAST(sum(CAST(round(duration_s * 1000000) AS BIGINT)) AS BIGINT)::DOUBLE / count(*) / 1e6 AS latency FROM fx_calls
  GROUP BY 1),
hours AS (SELECT unnest(generate_series((SELECT min(bucket_start) FROM seen), (SELECT max(bucket_start) FROM seen), INTERVAL 1 HOUR)) AS bucket_start),
b AS (SELECT h.bucket_start, coalesce(traffic, 0) AS traffic, coalesce(tokens, 0) AS tokens, latency
  FROM hours h LEFT JOIN seen s ON s.bucket_start = h.bucket_start),
z AS (SELECT bucket_start, """ + ", ".join(
             f"CASE WHEN stddev_samp({c}) OVER w > 0 THEN ({c} - avg({c}) OVER w) / stddev_samp({c}) OVER w END AS {c}_z"
             for c in ("traffic", "tokens", "latency")) + """
  FROM b WINDOW w AS (ORDER BY bucket_start ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING))
SELECT bucket_start, round(traffic_z, 6) AS traffic_z, round(tokens_z, 6) AS tokens_z, round(latency_z, 6) AS latency_z,
  coalesce(traffic_z < -2, false) AS traffic_drop, coalesce(tokens_z > 2, false) AS token_spike, coalesce(latency_z > 2, false) AS latency_anomaly,
  coalesce(traffic_z < -2, false) OR coalesce(tokens_z > 2, false) OR coalesce(latency_z > 2, false) AS anomalous FROM z"""),
    *ALERT_PLANS,
    Plan("alert_groups", lambda d: A.group_changes(all_alerts(d)), groups_sql("MONITORING")),
    Plan("alert_groups_default", lambda d: A.group_changes(all_alerts(d), "DEFAULT"), groups_sql("DEFAULT")),
    Plan("alert_group_lines", lambda d: A.group_lines(all_alerts(d)), lines_sql("MONITORING", _LINES)),
    Plan("alert_group_lines_default", lambda d: A.group_lines(all_alerts(d), "DEFAULT"), lines_sql("DEFAULT", _DEFAULT_LINES)),
    Plan("alert_text_default", lambda d: A.alert_text(all_alerts(d), "DEFAULT").select(*_TEXT_COLUMNS), text_sql(_DEFAULT_LINES)),
    Plan("alert_text", lambda d: A.alert_text(all_alerts(d)).select(*_TEXT_COLUMNS), text_sql(_LINES)),
]
