"""Device telemetry: derived metrics, rules with durations, active alerts, predicted trends, and rendered responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.detect import trend
from tessera.session import small_side

#: The default rules: id, severity, metric, comparison, threshold, seconds that it must last, action.
DEFAULT_RULES = (
    ("temp_warning", "warning", "temperature_c", "gte", 80.0, 60, "notify"),
    ("temp_critical", "critical", "temperature_c", "gt", 85.0, 30, "throttle"),
    ("power_spike", "warning", "power_w", "gt", 400.0, 45, "notify"),
    ("power_critical", "critical", "power_w", "gte", 450.0, 20, "preempt"),
    ("ecc_spike", "warning", "ecc_errors_correctable", "gte", 10.0, 300, "notify"),
    ("ecc_uncorrectable", "critical", "ecc_errors_uncorrectable", "gte", 1.0, 0, "quarantine"),
    ("throttling", "warning", "throttled", "eq", 1.0, 30, "notify"),
    ("memory_pressure", "warning", "memory_utilization_percent", "gte", 90.0, 60, "notify"),
)
#: Fixed value: megabytes of a device's memory where nothing else is known.
MEMORY_MB = 40_960
METRICS = ("temperature_c", "power_w", "utilization_percent", "memory_used_mb", "memory_utilization_percent", "ecc_errors_correctable", "ecc_errors_uncorrectable", "throttled")


def default_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(DEFAULT_RULES), "rule_id string, severity string, metric string, cmp string, threshold double, seconds int, action string")


def metrics(health: DataFrame) -> DataFrame:
    """device, us, metric, value: a row for each metric of a sample, derived ones too; null metrics give none."""
    value = {"memory_utilization_percent": F.col("memory_used_mb") / MEMORY_MB * 100, "throttled": F.when(F.col("throttled"), 1.0).otherwise(0.0)}
    each = F.map_from_arrays(F.array(*[F.lit(m) for m in METRICS]), F.array(*[value.get(m, F.col(m) if m not in value else F.lit(None)).cast("double") for m in METRICS]))
    return health.select("device", "us", F.explode(each).alias("metric", "value")).where("value IS NOT NULL")


def compare(value: Column, cmp: Column, threshold: Column) -> Column:
    hit = F.when(cmp == "gt", value > threshold).when(cmp == "gte", value >= threshold).when(cmp == "lt", value < threshold).when(cmp == "lte", value <= threshold).when(cmp == "eq", value == threshold)
    return F.coalesce(hit, F.lit(False))


def alerts(health: DataFrame, rules: DataFrame) -> DataFrame:
    """device, us, rule_id, severity, action, value: samples at which a rule has been broken without a break for its seconds."""
    m = metrics(health).join(small_side(rules), "metric")
    w = Window.partitionBy("device", "rule_id").orderBy("us")
    bad = compare(F.col("value"), F.col("cmp"), F.col("threshold"))
    runs = m.withColumn("__bad", bad).withColumn("__run", F.sum(F.when(F.col("__bad"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("__bad")
    since = F.min("us").over(Window.partitionBy("device", "rule_id", "__run"))
    return runs.withColumn("__since", since).where(F.col("us") - F.col("__since") >= F.col("seconds") * 1_000_000).select("device", "us", "rule_id", "severity", "action", "value")


def active(alert: DataFrame, cleared: DataFrame) -> DataFrame:
    """The newest alert of each device and rule that was not cleared (device, rule_id, cleared_us) at or after it."""
    last = alert.groupBy("device", "rule_id").agg(F.max("us").alias("us"), F.max_by("severity", "us").alias("severity"))
    c = cleared.groupBy("device", "rule_id").agg(F.max("cleared_us").alias("cleared_us"))
    d = last.join(c, ["device", "rule_id"], "left")
    return d.where("cleared_us IS NULL OR cleared_us < us").select("device", "rule_id", "us", "severity")


def forecast(sample: DataFrame, critical: float = 100.0) -> DataFrame:
    """trend() with seconds_left until the critical value (null unless it rises towards it) and confidence (0 there)."""
    up = (F.col("direction") == "increasing") & (F.col("rate") > 0) & (F.col("value") < critical)
    d = trend(sample)
    return d.withColumn("seconds_left", F.when(up, (F.lit(critical) - F.col("value")) / (F.col("rate") / 60))).withColumn("confidence", F.when(up, F.least(F.lit(0.95), F.abs("rate") / 10)).otherwise(0.0))


#: Action, status, message, what is named in it.
RESPONSES = (
    ("alert", "alerted", "Alert for detection ", "event_id"),
    ("log", "logged", "Logged detection ", "event_id"),
    ("isolate", "isolated", "Isolated process ", "pid"),
    ("kill_process", "killed", "Killed process ", "pid"),
    ("quarantine", "quarantined", "Quarantined file ", "file_path"),
)


def rendered(routed: DataFrame) -> DataFrame:
    """routed (action, event_id, pid, file_path) and the status and message of its response."""
    status, message = F.lit("unknown"), F.lit("Unknown action")
    for action, say, text, what in RESPONSES:
        here = F.col("action") == action
        status = F.when(here, say).otherwise(status)
        message = F.when(here, F.concat(F.lit(text), F.coalesce(F.col(what).cast("string"), F.lit("None")))).otherwise(message)
    return routed.withColumn("status", status).withColumn("message", message)
