"""Alert rules over metrics, their lifecycle, and notifications.

A rule turns metrics into condition rows (series, tick, value, firing) on a
fixed grid; ``sustained`` turns those into alerts with a start and an end; and
``group_changes`` and ``group_lines`` turn alerts into the messages of their groups.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlight.functions import times
from wardlight.operators import metrics as M

# Fixed value: labels of a report that ask for an alert.
REPORTABLE = ("High", "Critical")

# What an alert raised by human feedback says.
FEEDBACK_TYPE = "Human Override/Correction"
FEEDBACK_SOURCE = "N/A (Feedback)"
NO_ACTION = "N/A"


@dataclass(frozen=True)
class Rule:
    """Name, severity, how long the condition must hold, and the texts."""

    name: str
    severity: str
    hold: str
    summary: str
    description: str


# The alert rules' names, severities, hold times and texts.
RULES = {r.name: r for r in (
    Rule("HighLLMLatency", "critical", "2m", "LLM  Latency is too high",
         "P95 latency is {value}s, which is above the 5s threshold for 2 minutes."),
    Rule("LowClassificationConfidence", "warning", "3m", "Classification confidence dropped below 0.8",
         "AI model classification confidence has dropped below acceptable threshold. Current confidence: {value}."),
    Rule("HighErrorRate", "critical", "2m", "High Error Rate Detected",
         "Error rate is {value}%, exceeding the 5% limit."),
    Rule("PodCrashLooping", "warning", "5m", "Pod is crash looping",
         "Pod {pod} has restarted more than 3 times in the last 15 minutes."),
    Rule("HighCPUUsage", "warning", "2m", "CPU Usage is high",
         "CPU usage is above than 80% for more than 2 minutes"),
    Rule("HighMemoryUsage", "warning", "2m", "High memory usage",
         "Memory usage above 500MB on {instance}."),
    Rule("SLOBreach", "critical", "5m", "SLO Breach",
         "Availability is less than 99.9% for more than 5 mins"),
    Rule("HighTokenUsage", "warning", "3m", "High token usage",
         "Token usage is high for more than 3 mins."),
    Rule("LLMHighErrorRate", "critical", "5m", "LLM high error rate",
         "Error rate of LLM is {value}%, exceeding the 10% limit."),
)}

STEP = 15
CPU_SECONDS = "process_cpu_seconds_total"
MEMORY_BYTES = "process_resident_memory_bytes"
RESTARTS = "kube_pod_container_status_restarts_total"


# ---- conditions that hold for a while ----

def sustained(
    conditions: DataFrame, hold: str | int, by: Sequence[str], step: str | int = STEP,
    end: Column | None = None,
) -> DataFrame:
    """Runs of consecutive firing ticks that last at least ``hold``.

    Gives since (first firing tick), fires_at (since + hold), resolved_at (the
    tick after the run, null if the run reaches the end of the evaluation), and
    the last value. The end is by default the last tick of all series, so a
    series that stops resolves. Rows are grid ticks, so a series is as long as
    its time span.
    """
    end = M.last_tick(conditions) if end is None else end
    width, need = times.seconds_of(step), times.seconds_of(hold)
    order = M.series_order(by)
    tick = F.col("tick")
    firing = (
        conditions.withColumn("_open", tick >= end)
        .filter(F.col("firing"))
        .withColumn("_run", tick - F.row_number().over(order) * F.lit(width))
    )
    runs = firing.groupBy(*by, "_run").agg(
        F.min("tick").alias("_since"),
        F.max("tick").alias("_until"),
        F.bool_or("_open").alias("_open"),
        F.max_by("value", "tick").alias("value"),
    ).filter(F.col("_until") - F.col("_since") >= need)
    resolved = F.when(~F.col("_open"), times.at_second(F.col("_until") + F.lit(width)))
    return runs.select(
        *by,
        times.at_second(F.col("_since")).alias("since"),
        times.at_second(F.col("_since") + F.lit(need)).alias("fires_at"),
        resolved.alias("resolved_at"),
        "value",
    )


def _alert(source: DataFrame, conditions: DataFrame, rule: Rule, by: Sequence[str], step, hold=None) -> DataFrame:
    """Alert rows with the rule's labels and texts; the last time of ``source`` ends the evaluation."""
    runs = sustained(conditions, rule.hold if hold is None else hold, by, step, M.end_of(source, step))
    text = F.lit(rule.description)
    for label in ("instance", "pod"):
        if label in by:
            text = F.replace(text, F.lit(f"{{{label}}}"), F.coalesce(F.col(label).cast("string"), F.lit("")))
    # shortest form, as in 6.25 or 6
    value = F.regexp_replace(F.round(F.col("value").cast("double"), 6).cast("string"), r"\.0$", "")
    return runs.select(
        F.lit(rule.name).alias("alertname"),
        F.lit(rule.severity).alias("severity"),
        *by,
        "since", "fires_at", "resolved_at",
        F.col("value").cast("double").alias("value"),
        F.lit(rule.summary).alias("summary"),
        F.replace(text, F.lit("{value}"), value).alias("description"),
    )


def judged(rows: DataFrame, value: Column, test) -> DataFrame:
    named = rows.withColumn("value", value)
    return named.withColumn("firing", F.coalesce(test(F.col("value")), F.lit(False)))


def latency_condition(calls, threshold=5.0, window="5 minutes", step=STEP, by=("instance",), q=0.95,
                      bounds=M.BOUNDS):
    """p95 of the window from bucket counts that are summed over its ticks."""
    names = [f"b{i}" for i in range(len(bounds) + 1)]
    counted = M.bucket_counts(
        calls.withColumn("tick", times.tick_of(F.col("ts"), step)), [*by, "tick"], bounds
    )
    summed = M.rolling(counted, by, step, window, names, M.end_of(calls, step))
    value = M.quantile_of(F.array(*[F.col(n) for n in names]), bounds, q)
    return judged(summed.withColumn("value", value).select(*by, "tick", "value"),
                   F.col("value"), lambda v: v > F.lit(float(threshold)))


def alert_HighLLMLatency(calls, threshold=5.0, window="5 minutes", step=STEP, hold=None, by=("instance",)):
    rows = latency_condition(calls, threshold, window, step, by)
    return _alert(calls, rows, RULES["HighLLMLatency"], by, step, hold)


def alert_LowClassificationConfidence(calls, threshold=0.8, step=STEP, hold=None, lookback=M.LOOKBACK,
                                      by=("instance", "label")):
    gauges = calls.withColumn("label", F.col("severity"))
    ticks = M.gauge_ticks(gauges, by, step, lookback, col="confidence")
    rows = judged(ticks, F.col("value"), lambda v: v < F.lit(float(threshold)))
    return _alert(calls, rows, RULES["LowClassificationConfidence"], by, step, hold)


def error_share(calls, window="5 minutes", step=STEP, by: Sequence[str] = ()):
    """Share of 5xx requests in the sliding window per series."""
    counted = M.slices(calls, by, step, total=F.count(F.lit(1)), bad=F.count_if(F.col("status") >= 500))
    summed = M.rolling(counted, by, step, window, ["total", "bad"], M.end_of(calls, step))
    return summed.select(*by, "tick", F.try_divide(F.col("bad"), F.col("total")).alias("share"))


def alert_HighErrorRate(calls, threshold=0.05, window="5 minutes", step=STEP, hold=None):
    rows = judged(error_share(calls, window, step), F.col("share"), lambda v: v > F.lit(float(threshold)))
    return _alert(calls, rows, RULES["HighErrorRate"], (), step, hold)


def alert_SLOBreach(calls, target=0.999, window="5 minutes", step=STEP, hold=None, by=("instance",)):
    rows = judged(error_share(calls, window, step, by), F.lit(1.0) - F.col("share"),
                   lambda v: v < F.lit(float(target)))
    return _alert(calls, rows, RULES["SLOBreach"], by, step, hold)


def alert_LLMHighErrorRate(calls, threshold=0.1, window="5 minutes", step=STEP, hold=None, by=("instance",)):
    rows = judged(error_share(calls, window, step, by), F.col("share"),
                   lambda v: v > F.lit(float(threshold)))
    return _alert(calls, rows, RULES["LLMHighErrorRate"], by, step, hold)


def alert_HighTokenUsage(calls, threshold=10.0, window="5 minutes", step=STEP, hold=None,
                         by=("instance",), count_tokens: bool = False):
    """Rate of calls above the limit; with count_tokens the rate of tokens."""
    amount = F.sum(F.col("prompt_tokens") + F.col("completion_tokens")) if count_tokens else F.count(F.lit(1))
    counted = M.slices(calls, by, step, events=amount)
    seconds = float(times.seconds_of(window))
    summed = M.rolling(counted, by, step, window, ["events"], M.end_of(calls, step))
    rows = judged(summed, F.col("events") / F.lit(seconds), lambda v: v > F.lit(float(threshold)))
    return _alert(calls, rows, RULES["HighTokenUsage"], by, step, hold)


def samples_of(samples: DataFrame, name: str, *labels: str) -> DataFrame:
    """The samples of one metric: ts, value, series, and the given labels as columns.

    A series is told by all its labels, whether or not they are asked for, so
    counters of two containers of a pod stay apart. The labels are the map
    ``labels``, or every further column; an empty label is none.
    """
    own = samples.filter(F.col("name") == name)
    if "labels" in samples.columns:
        given = {n: F.try_element_at("labels", F.lit(n)) for n in labels}
        shown = F.transform(
            F.filter(F.array_sort(F.map_entries("labels")), lambda e: e["value"] != ""),
            lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    else:
        others = sorted(c for c in samples.columns if c not in ("ts", "name", "value"))
        given = {n: F.col(n) if n in others else F.lit(None).cast("string") for n in labels}
        texts = [F.when(F.col(c).cast("string") != "", F.concat(F.lit(f"{c}="), F.col(c).cast("string"))) for c in others]
        shown = F.array_compact(F.array(F.lit(None).cast("string"), *texts))
    return own.select("ts", "value", F.array_join(shown, ",").alias("series"), *[c.alias(n) for n, c in given.items()])


def alert_PodCrashLooping(samples, threshold=3.0, window="15 minutes", step=STEP, hold=None, labels=("namespace", "pod", "container")):
    by = ("series", *labels)
    own = samples_of(samples, RESTARTS, *labels)
    grown = M.increase(own, window, step, by)
    rows = judged(grown, F.col("increase"), lambda v: v > F.lit(float(threshold)))
    return _alert(own, rows, RULES["PodCrashLooping"], by, step, hold)


def alert_HighCPUUsage(samples, threshold=0.8, window="5 minutes", step=STEP, hold=None, labels=("namespace", "instance", "job")):
    by = ("series", *labels)
    own = samples_of(samples, CPU_SECONDS, *labels)
    used = M.rate(own, window, step, by)
    rows = judged(used, F.col("rate"), lambda v: v > F.lit(float(threshold)))
    return _alert(own, rows, RULES["HighCPUUsage"], by, step, hold)


def alert_HighMemoryUsage(samples, threshold=500_000_000, step=STEP, hold=None, lookback=M.LOOKBACK,
                          labels=("namespace", "instance", "job")):
    by = ("series", *labels)
    own = samples_of(samples, MEMORY_BYTES, *labels)
    ticks = M.gauge_ticks(own, by, step, lookback)
    rows = judged(ticks, F.col("value"), lambda v: v > F.lit(float(threshold)))
    return _alert(own, rows, RULES["HighMemoryUsage"], by, step, hold)


# ---- reports and feedback that alert ----

def _list_text(items: Column) -> Column:
    """A list of texts the way Python prints one."""
    def quoted(item: Column) -> Column:
        body = F.replace(F.replace(item, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
        single = F.contains(item, F.lit("'"))
        escaped = F.replace(body, F.lit("'"), F.lit("\\'"))
        return (
            F.when(single & ~F.contains(item, F.lit('"')), F.concat(F.lit('"'), body, F.lit('"')))
            .otherwise(F.concat(F.lit("'"), escaped, F.lit("'")))
        )

    return F.concat(F.lit("["), F.array_join(F.transform(items, quoted), ", "), F.lit("]"))


def filter_reportable(reports: DataFrame, feedback: DataFrame | None = None) -> DataFrame:
    """Reports, and feedback rows in the shape of reports, that ask for an alert."""
    wanted = reports.filter(F.col("severity").isin(*REPORTABLE)).select(
        "incident_id", "severity", "anomaly_type", "source_ip",
        _list_text(F.col("recommended_actions")).alias("action"),
    )
    if feedback is None:
        return wanted
    corrected = feedback.filter(F.col("human_severity").isin(*REPORTABLE)).select(
        "incident_id",
        F.col("human_severity").alias("severity"),
        F.lit(FEEDBACK_TYPE).alias("anomaly_type"),
        F.lit(FEEDBACK_SOURCE).alias("source_ip"),
        F.concat(F.lit("Feedback provided: "), F.coalesce("comment", F.lit(""))).alias("action"),
    )
    return wanted.unionByName(corrected)


def payload(severity: Column, anomaly_type: Column, source_ip: Column, action: Column) -> Column:
    """The notification document of an alert as JSON text."""
    def markdown(*parts) -> Column:
        return F.struct(F.lit("mrkdwn").alias("type"), F.concat(*parts).alias("text"))

    header = F.to_json(F.struct(
        F.lit("header").alias("type"),
        F.struct(
            F.lit("plain_text").alias("type"),
            F.concat(F.lit("🚨 "), F.upper(severity), F.lit(" Incident Detected")).alias("text"),
            F.lit(True).alias("emoji"),
        ).alias("text"),
    ))
    fields = F.to_json(F.struct(
        F.lit("section").alias("type"),
        F.array(
            markdown(F.lit("*Type:*\n"), anomaly_type),
            markdown(F.lit("*Source IP:*\n`"), source_ip, F.lit("`")),
        ).alias("fields"),
    ))
    told = F.to_json(F.struct(
        F.lit("section").alias("type"),
        markdown(F.lit("*Recommended Action:*\n"), F.coalesce(action, F.lit(NO_ACTION))).alias("text"),
    ))
    return F.concat(F.lit('{"blocks":['), F.concat_ws(",", header, fields, told), F.lit("]}"))


def report_payload() -> Column:
    """The notification of a report row, null where its severity asks for none."""
    columns = (F.col("severity"), F.col("anomaly_type"), F.col("source_ip"), _list_text(F.col("recommended_actions")))
    return F.when(F.col("severity").isin(*REPORTABLE), payload(*columns))


def alert_payload(reportable: DataFrame) -> DataFrame:
    """The notification document of each alert."""
    columns = [F.col(c) for c in ("severity", "anomaly_type", "source_ip", "action")]
    return reportable.select("incident_id", "severity", payload(*columns).alias("payload"))


# ---- messages ----

# Receivers and titles.
CRITICAL_RECEIVER, DEFAULT_RECEIVER = "slack-critical", "slack-alerts"
IGNORED = "Watchdog"
CRITICAL_TITLE = ":rotating_light: CRITICAL [{place}] "
DEFAULT_TITLE = ":warning: [{place}] "


def routed(alerts: DataFrame, place: str = "MONITORING") -> DataFrame:
    """Drop the heartbeat and add receiver and title."""
    critical = F.col("severity") == "critical"
    title = F.when(critical, CRITICAL_TITLE.format(place=place)).otherwise(DEFAULT_TITLE.format(place=place))
    return alerts.filter(F.col("alertname") != IGNORED).withColumns({
        "receiver": F.when(critical, CRITICAL_RECEIVER).otherwise(DEFAULT_RECEIVER),
        "title": F.concat(title, F.col("alertname")),
    })


# The lines of an alert's text by place, as (label, column, optional, quoted).
# An optional line is left out when the alert has no such label.
TEXT_LINES = {
    "MONITORING": (
        ("Alert", "alertname", False, False), ("Namespace", "namespace", False, False),
        ("Severity", "severity", False, False), ("Summary", "summary", False, False),
        ("Description", "description", False, False), ("Instance", "instance", True, True),
        ("Pod", "pod", True, True),
    ),
    "DEFAULT": (
        ("Alert", "alertname", False, False), ("Severity", "severity", False, False),
        ("Summary", "summary", False, False), ("Description", "description", False, False),
        ("Instance", "instance", True, False), ("Pod", "pod", True, False),
        ("Namespace", "namespace", True, False),
    ),
}


def alert_text(alerts: DataFrame, place: str = "MONITORING") -> DataFrame:
    """The lines that one alert adds to the notification of its group."""
    def line(label: str, name: str, optional: bool, quoted: bool) -> Column:
        known = F.col(name).cast("string") if name in alerts.columns else F.lit(None).cast("string")
        value = F.coalesce(known, F.lit(""))
        mark = F.lit("`" if quoted else "")
        shown = F.concat(F.lit(f"*{label}:* "), mark, value, mark)
        return F.when(value != "", shown) if optional else shown

    return alerts.withColumn("text", F.concat_ws("\n", *[line(*spec) for spec in TEXT_LINES[place]]))


GROUP = ("alertname", "severity")


def group_changes(alerts: DataFrame, place: str = "MONITORING") -> DataFrame:
    """One row per (alertname, severity) and moment at which an alert of the group fires or resolves.

    ``fired`` and ``resolved`` tell how many do so then, ``firing`` how many
    fire from then on; receiver and title are the group's. A sweep over the
    changes: every alert is a step up and, once it has ended, a step down, and
    the running count is taken within a day on top of the totals of the days
    before, so a group with very many alerts is spread over its days.
    """
    told = routed(alerts, place).select(*GROUP, "receiver", "title", "fires_at", "resolved_at")
    up, down = F.struct(F.col("fires_at").alias("at"), F.lit(1).alias("step")), F.struct(F.col("resolved_at").alias("at"), F.lit(-1).alias("step"))
    steps = told.select(*GROUP, "receiver", "title", F.inline(F.array(up, down))).filter(F.col("at").isNotNull())
    changes = steps.groupBy(*GROUP, "receiver", "title", "at").agg(
        F.count_if(F.col("step") > 0).alias("fired"), F.count_if(F.col("step") < 0).alias("resolved")
    ).withColumn("_day", F.to_date("at"))
    grown = F.col("fired") - F.col("resolved")
    before = Window.partitionBy(*GROUP).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = changes.groupBy(*GROUP, "_day").agg(F.sum(grown).alias("_sum")).select(
        *GROUP, "_day", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    until = Window.partitionBy(*GROUP, "_day").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return changes.join(days, [*GROUP, "_day"]).withColumn("firing", F.col("_base") + F.sum(grown).over(until)).select(
        *GROUP, "at", "receiver", "title", "fired", "resolved", "firing")


def group_lines(alerts: DataFrame, place: str = "MONITORING") -> DataFrame:
    """The text of every alert as a row of its group, with the span in which the group tells it.

    A group's message at a moment holds the lines that ``told_at`` leaves, in
    the order of (text, since). Nothing is gathered, so a group may have any
    number of alerts.
    """
    return alert_text(routed(alerts, place), place).select(*GROUP, "receiver", "title", "since", "fires_at", "resolved_at", "text")


def told_at(lines: DataFrame, moment, recent: str | int = "5m") -> DataFrame:
    """The lines that fire at a moment or have resolved less than ``recent`` before, and which of both."""
    at = times.moment(moment)
    gone = F.col("resolved_at") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(times.seconds_of(recent)).cast("decimal(18,6)"))
    return lines.filter((F.col("fires_at") <= at) & (F.col("resolved_at").isNull() | (at < gone))).withColumn(
        "status", F.when(F.col("resolved_at") <= at, F.lit("resolved")).otherwise(F.lit("firing")))


def alert_groups(alerts: DataFrame, instants: Column, recent: str | int = "5m", place: str = "MONITORING") -> DataFrame:
    """One row per (alertname, severity, evaluation instant) with something to tell.

    For a few given moments and groups of a modest size; ``group_changes`` and
    ``group_lines`` tell every change of groups of any size.
    ``instants`` is an array of the moments at which groups are looked at. A
    group tells its alerts that fire then and those that resolved less than
    ``recent`` before; the row has both counts, receiver, title and the lines
    of all these alerts, in the order of their text. An alert is copied only to
    instants that tell it.
    """
    seconds = times.seconds_of(recent)
    gone = F.col("resolved_at") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds).cast("decimal(18,6)"))
    told = F.filter(instants, lambda t: (t >= F.col("fires_at")) & (F.col("resolved_at").isNull() | (t < gone)))
    lines = alert_text(routed(alerts, place), place).withColumn("evaluated_at", F.explode(told))
    fires = F.col("resolved_at").isNull() | (F.col("evaluated_at") < F.col("resolved_at"))
    in_order = F.array_sort(F.collect_list(F.struct("text", "since")))
    return lines.groupBy("alertname", "severity", "evaluated_at", "receiver", "title").agg(
        F.count_if(fires).alias("firing"),
        F.count_if(~fires).alias("resolved"),
        F.array_join(F.transform(in_order, lambda x: x["text"]), "\n\n").alias("text"),
    )
