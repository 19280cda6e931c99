"""Rules over events, baselines, alerts with duration, trends, and first-match policies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.running import rolling
from tessera.session import small_side

#: rule_ord, rule_id, severity, enabled, pattern, threshold
RULES = ((0, "rule-low", "INFO", True, "view", 0.5), (1, "rule-error", "CRITICAL", True, "error", 0.95), (2, "rule-buy", "WARNING", True, "purchase", 0.8), (3, "rule-off", "HIGH", False, "click", 0.99), (4, "rule-blank", "HIGH", True, "", 0.99), (5, "rule-user", "HIGH", True, "17", 0.95))
RULES_SQL = " UNION ALL ".join(f"SELECT {o} AS rule_ord, '{i}' AS rule_id, '{s}' AS severity, {str(e).lower()} AS enabled, '{p}' AS pattern, {t}::DOUBLE AS threshold" for o, i, s, e, p, t in RULES)


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(RULES), "rule_ord int, rule_id string, severity string, enabled boolean, pattern string, threshold double")


def matches(events: DataFrame, rule: DataFrame) -> DataFrame:
    """A row for each enabled rule whose pattern an event's values contain. rule: a small dimension table."""
    live = rule.where("enabled AND pattern <> ''")
    e = events.withColumn("__s", F.concat_ws(" ", "event_type", F.col("user_id").cast("string"), "props"))
    return e.join(small_side(live), F.col("__s").contains(F.col("pattern"))).drop("__s")


def best(events: DataFrame, rule: DataFrame, least: float = 0.8) -> DataFrame:
    """The highest threshold that matched, the first of ties, from `least` on: a map-side maximum, no window."""
    top = F.max_by(F.struct("rule_id", "threshold", "severity"), F.struct("threshold", -F.col("rule_ord"))).alias("b")
    return matches(events, rule).groupBy("event_id").agg(top).where(F.col("b.threshold") >= least).select("event_id", "b.rule_id", F.col("b.threshold").alias("score"), "b.severity")


def route(found: DataFrame) -> DataFrame:
    action = F.when(F.col("severity") == "CRITICAL", "kill_process").when(F.col("severity") == "HIGH", "block").when(F.col("severity") == "WARNING", "alert")
    return found.select("event_id", "severity", action.alias("action")).where("action IS NOT NULL")


def zscore(df: DataFrame, key: str, order: str, value: str, limit: float = 2.0, last: int = 1000, least: int = 10) -> DataFrame:
    """df with anomalous: beyond limit population deviations of the `last` earlier values; too few or equal ones: false."""
    d = rolling(df, key, order, value, last)
    hit = (F.col("n") >= least) & (F.col("sd") > 0) & (F.abs(F.col(value) - F.col("mean")) > limit * F.col("sd"))
    return d.select(*df.columns, F.coalesce(hit, F.lit(False)).alias("anomalous"))


def samples(events: DataFrame) -> DataFrame:
    return events.select("event_id", F.col("user_id").alias("device"), F.expr("unix_micros(CAST(ts AS TIMESTAMP))").alias("us"), "value")


def alert_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("hot", "gt", 90.0), ("cold", "lt", 5.0), ("edge", "gte", 99.0)], "rule_id string, cmp string, threshold double")


def alerts(sample: DataFrame, rule: DataFrame) -> DataFrame:
    v, t, c = F.col("value"), F.col("threshold"), F.col("cmp")
    hit = F.when(c == "gt", v > t).when(c == "gte", v >= t).when(c == "lt", v < t).when(c == "lte", v <= t).when(c == "eq", v == t)
    return sample.join(small_side(rule), hit)


def durations(sample: DataFrame, threshold: float, micros: int) -> DataFrame:
    """Violating samples with firing: the run of violations of the device has lasted `micros` or longer (event time)."""
    order = Window.partitionBy("device").orderBy("us", "event_id")
    bad = F.col("value") > threshold
    island = F.sum(F.when(bad, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    runs = sample.withColumn("island", island).where(bad)
    return runs.withColumn("since", F.min("us").over(Window.partitionBy("device", "island"))).withColumn("firing", F.col("us") - F.col("since") >= micros)


def trend(sample: DataFrame, micros: int = 86_400_000_000) -> DataFrame:
    """Change a minute over a trailing window of event time, and its direction."""
    w = Window.partitionBy("device").orderBy("us").rangeBetween(-(micros - 1), 0)
    span = (F.col("us") - F.min("us").over(w)) / 1e6
    rate = (F.col("value") - F.first("value").over(w)) / F.greatest(span, F.lit(1.0)) * 60
    d = sample.withColumn("first", F.first("value").over(w)).withColumn("rate", rate)
    return d.withColumn("direction", F.when(F.abs("rate") < 0.1, "stable").when(F.col("value") > F.col("first"), "increasing").otherwise("decreasing"))


def risk(trends: DataFrame, critical: float = 100.0) -> DataFrame:
    left = (F.lit(critical) - F.col("value")) / (F.col("rate") / 60)
    share = F.when(left < 300, 0.9).when(left < 600, 0.6).when(left < 1800, 0.3).otherwise(0.0)
    return trends.withColumn("risk", F.when(F.col("rate") < 0.1, 0.0).otherwise(F.least(F.lit(1.0), F.least(F.lit(0.95), F.col("rate") / 10) * share)))


POLICY = "policy_ord int, rule_ord int, rule_id string, kind string, effect string, roles array<string>, conditions map<string,string>, principals array<string>, actions array<string>, resources array<string>, enabled boolean"


def policies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [
            (0, 0, "r-off", "rbac", "deny", [], {}, [], [], [], False),
            (1, 0, "r-view", "rbac", "allow", [], {}, [], ["view"], ["database/*"], True),
            (1, 1, "r-role", "rbac", "allow", ["admin"], {}, [], ["click", "purchase"], [], True),
            (2, 0, "r-deny", "abac", "deny", [], {"env": "prod"}, [], ["error"], ["*"], True),
            (3, 0, "r-acl", "acl", "allow", [], {}, ["group-1"], ["*"], [], True),
        ],
        POLICY,
    )


def requests(events: DataFrame) -> DataFrame:
    """Requests made of events: role admin for each third user, attribute env, a group as principal."""
    return events.select("event_id", F.col("event_type").alias("action"), F.concat(F.lit("group-"), F.col("user_id") % 10).alias("principal"), F.when(F.col("user_id") % 3 == 0, F.array(F.lit("admin"))).otherwise(F.array(F.lit("user"))).alias("roles"), F.create_map(F.lit("env"), F.lit("prod")).alias("attributes"), F.lit("database/main").alias("resource"))


def wildcard(resource, patterns):
    """Anchored globs with * alone; an empty list fits."""
    glob = lambda p: F.rlike(resource, F.concat(F.lit("^"), F.array_join(F.transform(F.split(p, "[*]", -1), lambda x: F.concat(F.lit("\\Q"), x, F.lit("\\E"))), ".*"), F.lit("$")))
    return (F.size(patterns) == 0) | F.exists(patterns, glob)


def evaluate(request: DataFrame, policy: DataFrame) -> DataFrame:
    """event_id, rule_id, decision: the first rule that fits, by policy and rule order; none: deny. policy: a small table."""
    p = small_side(policy.where("enabled"))
    act = (F.size("actions") == 0) | F.array_contains("actions", "*") | F.expr("array_contains(actions, action)")
    who = (
        F.when(F.col("kind") == "rbac", (F.size(p["roles"]) == 0) | F.arrays_overlap(p["roles"], request["roles"]))
        .when(F.col("kind") == "abac", F.forall(F.map_entries("conditions"), lambda e: F.coalesce(F.element_at("attributes", e["key"]) == e["value"], F.lit(False))))
        .otherwise((F.size("principals") == 0) | F.expr("array_contains(principals, principal)"))
    )
    hit = request.join(p, act & wildcard(F.col("resource"), F.col("resources")) & who, "left")
    first = F.min_by(F.struct("rule_id", "effect"), F.struct("policy_ord", "rule_ord")).alias("r")
    return hit.groupBy("event_id").agg(first).select("event_id", "r.rule_id", F.coalesce("r.effect", F.lit("deny")).alias("decision"))
