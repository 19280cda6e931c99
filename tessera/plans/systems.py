"""Queries over logs, groups, transactions, objects, certificates, telemetry and vector collections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import vector as V
from tessera.operators import log, monitor, objects, search, transactions
from tessera.operators.collection import Collection
from tessera.operators.running import numbered
from tessera.sources.tables import table
from tessera.streaming import windows

QUERIES: dict = {}
ORACLE: dict = {}
PARTS, GROUPS = 4, 5


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("us", F.expr("unix_micros(CAST(ts AS TIMESTAMP))"))


# logs: events keyed by user, a purchase commits all before it ------------------------------------------------------

_HASH = "('0x' || substr(sha256(user_id::VARCHAR), 1, 8))::BIGINT"
_LOG = f"""log AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY event_id) - 1 AS off FROM (SELECT event_id, event_type, user_id, value, ts, {_HASH} % {PARTS} AS part FROM events))"""
_MARKS = f"{_LOG}, marks AS (SELECT part, max(off) + 1 AS log_end, coalesce(max(off) FILTER (event_type = 'purchase'), -1) AS hwm FROM log GROUP BY part)"
_COMMITS = f"{_MARKS}, commits AS (SELECT user_id % {GROUPS} AS grp, part, max(off) AS committed FROM log WHERE event_type = 'view' GROUP BY 1, 2)"


def _log(spark, sf_dir) -> DataFrame:
    return log.append(None, _events(spark, sf_dir).withColumn("part", log.partition_of(F.col("user_id"), PARTS)), "event_id")


@query(f"WITH {_LOG} SELECT event_id, part, off FROM log")
def log_assign_offsets(spark, sf_dir):
    return _log(spark, sf_dir).select("event_id", "part", "off")


@query(f"WITH {_LOG}, more AS (SELECT l.part, count(*) AS n FROM log l GROUP BY l.part) SELECT event_id, part, off FROM log UNION ALL SELECT r.event_id + 1000000, r.part, r.off + m.n FROM log r JOIN more m ON r.part = m.part")
def log_append(spark, sf_dir):
    first = _log(spark, sf_dir)
    again = first.drop("off").withColumn("event_id", F.col("event_id") + 1_000_000)
    return log.append(first, again, "event_id").select("event_id", "part", "off")


@query(f"WITH {_LOG} SELECT part, off, event_id FROM log WHERE part = 2 AND off >= 10 AND off < 60")
def log_fetch(spark, sf_dir):
    return log.fetch(_log(spark, sf_dir), 2, 10, 50).select("part", "off", "event_id")


@query(f"WITH {_LOG} SELECT part, off, coalesce(max(CASE WHEN event_type = 'purchase' THEN off END) OVER (PARTITION BY part ORDER BY off ROWS UNBOUNDED PRECEDING), -1) AS hwm FROM log")
def log_hwm(spark, sf_dir):
    return log.high_water(_log(spark, sf_dir), F.col("event_type") == "purchase").select("part", "off", "hwm")


@query(f"WITH {_MARKS} SELECT part, log_end, hwm FROM marks")
def log_partition_stats(spark, sf_dir):
    return log.marks(_log(spark, sf_dir), F.col("event_type") == "purchase")


@query(f"WITH {_MARKS} SELECT event_id, l.part, off FROM log l JOIN marks m ON l.part = m.part WHERE off < hwm OR l.part = 0")
def log_truncate(spark, sf_dir):
    """Every partition but 0 is cut at its high-water mark."""
    lg = _log(spark, sf_dir)
    ends = log.marks(lg, F.col("event_type") == "purchase").where("part <> 0").select("part", F.col("hwm").alias("end"))
    return log.truncate(lg, ends).select("event_id", "part", "off")


@query(f"SELECT event_id, {_HASH} % {PARTS} AS part, substr(sha256(concat_ws('|', user_id::VARCHAR, event_type, epoch_us(ts)::VARCHAR)), 1, 8) AS record_hash FROM events")
def log_keyed_partition(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", log.partition_of(F.col("user_id"), PARTS).alias("part"), log.record_hash(F.col("user_id"), F.col("event_type"), F.col("us")).alias("record_hash"))


@query("SELECT event_id, event_id % 3 <> 1 AS is_committed FROM events")
def log_produce_acks(spark, sf_dir):
    """acks of 1, 0 and -1 in turn."""
    return log.produced(_events(spark, sf_dir), F.lit(1) - F.col("event_id") % 3).select("event_id", "is_committed")


@query(f"WITH {_COMMITS} SELECT grp, part, committed FROM commits")
def group_offsets(spark, sf_dir):
    return log.offsets(_log(spark, sf_dir).where("event_type = 'view'").select((F.col("user_id") % GROUPS).alias("grp"), "part", "off"))


@query(f"WITH {_COMMITS} SELECT grp, c.part, committed, hwm, greatest(hwm - committed, 0) AS lag FROM commits c JOIN marks m ON c.part = m.part")
def group_lag(spark, sf_dir):
    lg = _log(spark, sf_dir)
    commits = log.offsets(lg.where("event_type = 'view'").select((F.col("user_id") % GROUPS).alias("grp"), "part", "off"))
    return log.lag(log.marks(lg, F.col("event_type") == "purchase"), commits)


_MEMBERS = f"m AS (SELECT user_id % {GROUPS} AS grp, user_id AS member, CASE event_type WHEN 'click' THEN 'join' WHEN 'error' THEN 'leave' ELSE 'heartbeat' END AS kind, event_id AS pos, epoch_us(ts) AS us FROM events)"


def _members(spark, sf_dir) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "join").when(F.col("event_type") == "error", "leave").otherwise("heartbeat")
    return _events(spark, sf_dir).select((F.col("user_id") % GROUPS).alias("grp"), F.col("user_id").alias("member"), kind.alias("kind"), F.col("event_id").alias("at"), "us")


@query(f"""WITH {_MEMBERS}, e AS (SELECT * FROM (SELECT *, coalesce(lag(kind) OVER (PARTITION BY grp, member ORDER BY pos), 'leave') AS was FROM m WHERE kind <> 'heartbeat') WHERE kind <> was),
l AS (SELECT grp, member, arg_max(kind, pos) AS kind, max(pos) AS since, count(*) AS moves FROM e GROUP BY grp, member)
SELECT grp, sum(moves)::BIGINT AS generation, count(*) FILTER (kind = 'join') AS members, arg_min(member, since) FILTER (kind = 'join') AS leader FROM l GROUP BY grp HAVING count(*) FILTER (kind = 'join') > 0""")
def group_summary(spark, sf_dir):
    return log.membership(_members(spark, sf_dir))


@query(f"WITH {_MEMBERS}, n AS (SELECT max(us) AS now FROM m) SELECT grp, member, arg_max(kind, (us, pos)) <> 'leave' AND max(us) >= max(now) - 86400000000 AS live FROM m, n GROUP BY grp, member")
def group_liveness(spark, sf_dir):
    m = _members(spark, sf_dir).withColumn("seq", F.col("at")).withColumn("at", F.col("us"))
    now = m.agg(F.max("us")).first()[0] or 0
    return log.live(m, now, 86_400_000_000, "seq")


_RANK = f"{_MEMBERS}, r AS (SELECT grp, member, row_number() OVER (PARTITION BY grp ORDER BY member) - 1 AS i, count(*) OVER (PARTITION BY grp) AS n FROM (SELECT DISTINCT grp, member FROM m)), p AS (SELECT unnest(range(0, 1000)) AS part)"


@query(f"WITH {_RANK} SELECT grp, member, part FROM r, p WHERE part >= i * (1000 // n) + least(i, 1000 % n) AND part < (i + 1) * (1000 // n) + least(i + 1, 1000 % n)")
def group_assign_range(spark, sf_dir):
    return log.assign(_members(spark, sf_dir), 1000)


@query(f"WITH {_RANK} SELECT grp, member, part FROM r, p WHERE part % n = i")
def group_assign_round_robin(spark, sf_dir):
    return log.assign(_members(spark, sf_dir), 1000, "round_robin")


# transactions: versions of orders, log records of events -----------------------------------------------------------

_VERSIONS = "v AS (SELECT o_orderkey, o_custkey, o_orderkey % 100 AS created_by, CASE WHEN o_orderkey % 7 = 0 THEN (o_orderkey + 13) % 100 ELSE 0 END AS deleted_by FROM orders)"


def _versions(spark, sf_dir) -> DataFrame:
    gone = F.when(F.col("o_orderkey") % 7 == 0, (F.col("o_orderkey") + 13) % 100).otherwise(0)
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderkey") % 100).alias("created_by"), gone.alias("deleted_by"))


@query(f"WITH {_VERSIONS} SELECT o_orderkey FROM v WHERE (created_by <= 60 AND created_by NOT IN (17, 42) OR created_by = 80) AND (deleted_by = 0 OR NOT (deleted_by <= 60 AND deleted_by NOT IN (17, 42) OR deleted_by = 80))")
def mvcc_visible_snapshot(spark, sf_dir):
    return _versions(spark, sf_dir).where(transactions.visible(60, [17, 42], own=80)).select("o_orderkey")


@query(f"WITH {_VERSIONS} SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM v WHERE created_by <= 60 AND created_by NOT IN (17, 42) AND (deleted_by = 0 OR NOT (deleted_by <= 60 AND deleted_by NOT IN (17, 42))) GROUP BY o_custkey")
def mvcc_read_committed(spark, sf_dir):
    return transactions.newest(_versions(spark, sf_dir), "o_custkey", "o_orderkey", transactions.visible(60, [17, 42])).select("o_custkey", "o_orderkey")


_WAL = """wal AS (SELECT event_id AS lsn, user_id AS txn, CASE event_type WHEN 'purchase' THEN 'commit' WHEN 'error' THEN 'abort' WHEN 'view' THEN 'insert' ELSE 'update' END AS kind, event_id % 64 AS page, value AS after, value - 1 AS before, epoch_us(ts) AS us FROM events)"""
_ARIES = f"""{_WAL}, late AS (SELECT * FROM wal WHERE lsn >= 100),
txns AS (SELECT txn, max(lsn) AS last_lsn, CASE arg_max(kind, lsn) WHEN 'commit' THEN 'committed' WHEN 'abort' THEN 'aborted' ELSE 'active' END AS state FROM late GROUP BY txn),
dirty AS (SELECT page, min(lsn) AS rec_lsn FROM late WHERE kind IN ('insert', 'update') GROUP BY page)"""


def _wal(spark, sf_dir) -> DataFrame:
    kind = F.when(F.col("event_type") == "purchase", "commit").when(F.col("event_type") == "error", "abort").when(F.col("event_type") == "view", "insert").otherwise("update")
    return _events(spark, sf_dir).select(F.col("event_id").alias("lsn"), F.col("user_id").alias("txn"), kind.alias("kind"), (F.col("event_id") % 64).alias("page"), F.col("value").alias("after"), (F.col("value") - 1).alias("before"), "us")


@query(f"WITH {_ARIES} SELECT txn, last_lsn, state FROM txns")
def wal_analysis_att(spark, sf_dir):
    return transactions.analysis(_wal(spark, sf_dir), 100)[0]


@query(f"WITH {_ARIES} SELECT page, rec_lsn FROM dirty")
def wal_analysis_dpt(spark, sf_dir):
    return transactions.analysis(_wal(spark, sf_dir), 100)[1]


@query(f"WITH {_ARIES} SELECT page, max(lsn) AS lsn, arg_max(after, lsn) AS image FROM wal JOIN dirty USING (page) WHERE kind IN ('insert', 'update') AND lsn >= rec_lsn AND (page % 3 <> 0 OR lsn > 500 + page) GROUP BY page")
def wal_redo(spark, sf_dir):
    """Each third page was stored as of lsn 500 + page."""
    w = _wal(spark, sf_dir)
    stored = spark.range(0, 64, 3).select(F.col("id").alias("page"), (F.col("id") + 500).alias("page_lsn"))
    return transactions.redo(w, transactions.analysis(w, 100)[1], stored)


@query(f"WITH {_ARIES} SELECT lsn, txn, page, before FROM wal JOIN txns USING (txn) WHERE state = 'active' AND kind IN ('insert', 'update')")
def wal_undo(spark, sf_dir):
    w = _wal(spark, sf_dir)
    return transactions.undo(w, transactions.analysis(w, 100)[0])


@query(f"WITH {_ARIES} SELECT (SELECT min(rec_lsn) FROM dirty) AS redo_lsn, (SELECT count(*) FROM dirty) AS dirty, (SELECT count(*) FROM txns WHERE state = 'active') AS active")
def wal_checkpoint(spark, sf_dir):
    return transactions.checkpoint(*transactions.analysis(_wal(spark, sf_dir), 100))


@query(f"""WITH {_WAL}, t AS (SELECT txn, arg_max(kind, lsn) AS last, max(us) - min(us) AS us FROM wal GROUP BY txn)
SELECT count(*) FILTER (last NOT IN ('commit', 'abort')) AS active, count(*) FILTER (last = 'commit') AS committed, count(*) FILTER (last = 'abort') AS aborted, round(avg(us / 1000.0) FILTER (last IN ('commit', 'abort')), 6) AS mean_ms FROM t""")
def txn_stats(spark, sf_dir):
    return transactions.stats(_wal(spark, sf_dir))


_LINKS = "e AS (SELECT DISTINCT n_nationkey AS a, (n_nationkey * 7 + 3) % 25 AS b FROM nation UNION SELECT n_nationkey, (n_nationkey + 1) % 25 FROM nation WHERE n_nationkey % 4 <> 3)"


def _links(spark, sf_dir) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("a"))
    return n.select("a", ((F.col("a") * 7 + 3) % 25).alias("b")).union(n.where("a % 4 <> 3").select("a", ((F.col("a") + 1) % 25).alias("b"))).distinct()


@query(f"WITH RECURSIVE {_LINKS}, w AS (SELECT 0::BIGINT AS src, 0::BIGINT AS node, 0 AS hops UNION SELECT w.src, e.b, w.hops + 1 FROM w JOIN e ON w.node = e.a WHERE w.hops < 25) SELECT src, node, min(hops) AS hops FROM w GROUP BY src, node")
def nvlink_shortest_path(spark, sf_dir):
    return transactions.distances(_links(spark, sf_dir), spark.range(1).select(F.col("id").alias("src")))


@query(f"WITH RECURSIVE {_LINKS}, w AS (SELECT a AS src, b AS node FROM e UNION SELECT w.src, e.b FROM w JOIN e ON w.node = e.a) SELECT x.n_nationkey::BIGINT AS src, count(DISTINCT CASE WHEN w.node <> w.src THEN w.node END) AS reached FROM nation x LEFT JOIN w ON w.src = x.n_nationkey GROUP BY x.n_nationkey")
def nvlink_connected(spark, sf_dir):
    """How many others each node reaches."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("src"))
    return transactions.distances(_links(spark, sf_dir), n).groupBy("src").agg((F.count(F.lit(1)) - 1).alias("reached"))


@query(f"WITH RECURSIVE {_LINKS}, w AS (SELECT a AS src, b AS node FROM e UNION SELECT w.src, e.b FROM w JOIN e ON w.node = e.a) SELECT DISTINCT src::BIGINT AS txn FROM w WHERE src = node")
def deadlock_cycles(spark, sf_dir):
    return transactions.cycles(_links(spark, sf_dir))


# objects and audit -----------------------------------------------------------------------------------------------


def _objects(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("object_id"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"))


_CHUNKS = "c AS (SELECT doc_id AS object_id, i AS sequence, encode(text)[i * 1024 + 1 : (i + 1) * 1024] AS data FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(octet_length(encode(text)) / 1024) AS BIGINT))) AS i FROM documents))"


@query(f"WITH {_CHUNKS} SELECT object_id, sequence, octet_length(data)::BIGINT AS size, sha256(data) AS checksum FROM c")
def obj_chunk(spark, sf_dir):
    return objects.chunks(_objects(spark, sf_dir), 1024).drop("data")


@query(f"WITH {_CHUNKS} SELECT object_id, bool_and(NOT (sequence = 0 AND object_id % 10 = 3)) AND count(*) = max(sequence) + 1 AS intact FROM c WHERE NOT (object_id % 10 = 4 AND sequence = 1) GROUP BY object_id")
def obj_verify(spark, sf_dir):
    """A tenth of the objects has a damaged first chunk, a tenth lacks its second."""
    c = objects.chunks(_objects(spark, sf_dir), 1024).where("NOT (object_id % 10 = 4 AND sequence = 1)")
    return objects.verify(c.withColumn("checksum", F.when((F.col("sequence") == 0) & (F.col("object_id") % 10 == 3), "bad").otherwise(F.col("checksum"))))


@query("SELECT doc_id AS object_id, sha256(text) AS checksum FROM documents WHERE text <> ''")
def obj_reassemble(spark, sf_dir):
    return objects.reassemble(objects.chunks(_objects(spark, sf_dir), 1024)).select("object_id", F.sha2("data", 256).alias("checksum"))


@query("SELECT doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS version, doc_id = max(doc_id) OVER (PARTITION BY source, lang) AS is_latest FROM documents")
def obj_versions(spark, sf_dir):
    return objects.versions(table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), ["source", "lang"], "doc_id").select("doc_id", "version", "is_latest")


@query("SELECT doc_id, lang IN ('en', 'de', 'fr') AS packed FROM documents")
def obj_compressible(spark, sf_dir):
    kind = F.when(F.col("lang") == "en", "text/plain").when(F.col("lang") == "de", "application/json; charset=utf-8").when(F.col("lang") == "fr", "TEXT/HTML").otherwise("image/png")
    return table(spark, sf_dir, "documents").select("doc_id", objects.compressible(kind).alias("packed"))


@query("SELECT event_id, 'node-' || user_id AS node, (user_id % 5) || '-consumer-' || event_id AS consumer, decode(from_base64(to_base64(encode(event_type)))) AS again FROM events")
def id_constructors(spark, sf_dir):
    e = _events(spark, sf_dir)
    return e.select("event_id", objects.identifier("node", F.col("user_id").cast("string")).alias("node"), objects.identifier("consumer", (F.col("user_id") % 5).cast("string"), F.col("event_id").cast("string")).alias("consumer"), F.unbase64(F.base64(F.encode("event_type", "UTF-8"))).cast("string").alias("again"))


@query()
def obj_crc32(spark, sf_dir):
    """Checked against zlib in the tests; the oracle has no CRC-32."""
    return _objects(spark, sf_dir).select("object_id", F.crc32("data").alias("crc32"))


_AUDIT = """'{"action":"' || event_type || '","at":' || event_id || ',"details":"{\\"value\\":' || CAST(user_id AS VARCHAR) || '}","event_type":"auth_allowed","principal_id":"user-' || user_id || '","resource_id":null,"result":"success"}'"""


@query(f"SELECT event_id, sha256({_AUDIT.replace(chr(92) + chr(34), chr(92) + chr(34))}) AS leaf_hash FROM events")
def audit_leaf_hash(spark, sf_dir):
    who = F.concat(F.lit("user-"), F.col("user_id"))
    a = objects.audit("auth_allowed", who, F.col("event_type"), F.lit(None).cast("string"), "success", F.col("event_id"), {"value": F.col("user_id")})
    return _events(spark, sf_dir).select("event_id", a["leaf_hash"].alias("leaf_hash"))


_CERTS = """c AS (SELECT o_orderkey AS cert_id, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey // 2 END AS issuer_id, o_orderdate AS a, o_orderdate + INTERVAL 900 DAY AS z, o_orderkey % 17 = 0 AS revoked FROM orders),
s AS (SELECT *, CASE WHEN revoked THEN 'revoked' WHEN TIMESTAMP '1997-01-01' < a THEN 'pending' WHEN TIMESTAMP '1997-01-01' <= z THEN 'valid' ELSE 'expired' END AS state, greatest(date_diff('day', DATE '1997-01-01', z::DATE), 0) AS days_left FROM c)"""


def _certs(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    c = o.select(F.col("o_orderkey").alias("cert_id"), F.when(F.col("o_orderkey") % 3 != 0, F.expr("o_orderkey div 2")).alias("issuer_id"), F.col("o_orderdate").alias("not_before"), F.expr("o_orderdate + INTERVAL '900' DAY").alias("not_after"), (F.col("o_orderkey") % 17 == 0).alias("revoked"))
    return objects.certificates(c, F.expr("TIMESTAMP_NTZ '1997-01-01 00:00:00'"), 30)


@query(f"WITH {_CERTS} SELECT cert_id, state, days_left, state = 'valid' AND days_left <= 30 AS rotate FROM s")
def cert_valid(spark, sf_dir):
    return _certs(spark, sf_dir).select("cert_id", "state", "days_left", "rotate")


@query(f"WITH RECURSIVE {_CERTS}, w AS (SELECT cert_id, issuer_id AS up, state = 'valid' AS ok FROM s UNION ALL SELECT w.cert_id, s.issuer_id, w.ok AND s.state = 'valid' FROM w JOIN s ON w.up = s.cert_id), e AS (SELECT cert_id, bool_or(up IS NULL) AS rooted, bool_and(ok) AS ok FROM w GROUP BY cert_id) SELECT cert_id, rooted AND ok AS trusted FROM e")
def cert_chains(spark, sf_dir):
    return objects.chains(_certs(spark, sf_dir).select("cert_id", "issuer_id", "state"), 64)


# telemetry -------------------------------------------------------------------------------------------------------

_HEALTH = "h AS (SELECT event_id, user_id AS device, epoch_us(ts) AS us, value AS temperature_c, value * 5 AS power_w, (event_id % 40960)::DOUBLE AS memory_used_mb, event_type = 'error' AS throttled, event_id % 13 AS ecc_errors_correctable, (event_id % 997 = 0)::INT AS ecc_errors_uncorrectable FROM events)"
_RULES = "r AS (SELECT * FROM (VALUES " + ", ".join(f"('{i}', '{s}', '{m}', '{c}', {t}, {d}, '{a}')" for i, s, m, c, t, d, a in monitor.DEFAULT_RULES) + ") t(rule_id, severity, metric, cmp, threshold, seconds, action))"
_FIRED = f"""{_HEALTH}, {_RULES}, m AS (SELECT device, us, unnest(['temperature_c', 'power_w', 'memory_utilization_percent', 'ecc_errors_correctable', 'ecc_errors_uncorrectable', 'throttled']) AS metric,
unnest([temperature_c, power_w, memory_used_mb / 40960 * 100, ecc_errors_correctable::DOUBLE, ecc_errors_uncorrectable::DOUBLE, throttled::INT::DOUBLE]) AS value FROM h),
b AS (SELECT *, CASE cmp WHEN 'gt' THEN value > threshold WHEN 'gte' THEN value >= threshold ELSE value = threshold END AS bad FROM m JOIN r USING (metric)),
g AS (SELECT *, sum((NOT bad)::INT) OVER (PARTITION BY device, rule_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS run FROM b),
f AS (SELECT * FROM (SELECT *, min(us) OVER (PARTITION BY device, rule_id, run) AS since FROM g WHERE bad) WHERE us - since >= seconds * 1000000)"""


def _health(spark, sf_dir) -> DataFrame:
    return _events(spark, sf_dir).select(
        F.col("user_id").alias("device"), "us", F.col("value").alias("temperature_c"), (F.col("value") * 5).alias("power_w"), F.lit(None).cast("double").alias("utilization_percent"), (F.col("event_id") % 40960).cast("double").alias("memory_used_mb"),
        (F.col("event_type") == "error").alias("throttled"), (F.col("event_id") % 13).alias("ecc_errors_correctable"), (F.col("event_id") % 997 == 0).cast("int").alias("ecc_errors_uncorrectable"),
    )


@query(f"WITH {_FIRED} SELECT device, us, rule_id, severity, action, round(value, 6) AS value FROM f")
def alert_default_rules(spark, sf_dir):
    return monitor.alerts(_health(spark, sf_dir), monitor.default_rules(spark)).withColumn("value", F.round("value", 6))


@query(f"WITH {_FIRED} SELECT device, rule_id, max(us) AS us, arg_max(severity, us) AS severity FROM f GROUP BY device, rule_id HAVING NOT (device % 2 = 0 AND rule_id = 'throttling')")
def alert_active(spark, sf_dir):
    """Throttling alerts of even devices have been cleared."""
    fired = monitor.alerts(_health(spark, sf_dir), monitor.default_rules(spark))
    cleared = fired.where("rule_id = 'throttling' AND device % 2 = 0").select("device", "rule_id", F.col("us").alias("cleared_us"))
    return monitor.active(fired, cleared)


@query(f"WITH {_HEALTH} SELECT device, us, round(memory_used_mb / 40960 * 100, 6) AS memory_utilization_percent FROM h")
def metric_derived(spark, sf_dir):
    m = monitor.metrics(_health(spark, sf_dir)).where("metric = 'memory_utilization_percent'")
    return m.select("device", "us", F.round("value", 6).alias("memory_utilization_percent"))


@query("SELECT event_id, CASE event_type WHEN 'error' THEN 'killed' WHEN 'view' THEN 'logged' WHEN 'click' THEN 'alerted' WHEN 'purchase' THEN 'isolated' ELSE 'quarantined' END AS status, CASE event_type WHEN 'error' THEN 'Killed process ' || user_id WHEN 'view' THEN 'Logged detection ' || event_id WHEN 'click' THEN 'Alert for detection ' || event_id WHEN 'purchase' THEN 'Isolated process ' || user_id ELSE 'Quarantined file None' END AS message FROM events")
def response_rendered(spark, sf_dir):
    act = F.when(F.col("event_type") == "error", "kill_process").when(F.col("event_type") == "view", "log").when(F.col("event_type") == "click", "alert").when(F.col("event_type") == "purchase", "isolate").otherwise("quarantine")
    d = _events(spark, sf_dir).select("event_id", act.alias("action"), F.col("user_id").alias("pid"), F.lit(None).cast("string").alias("file_path"))
    return monitor.rendered(d).select("event_id", "status", "message")


# vector collections ----------------------------------------------------------------------------------------------


def _vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def _asked(spark, sf_dir) -> DataFrame:
    return _vectors(spark, sf_dir).where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))


def _collection(spark, sf_dir) -> Collection:
    """All vectors; each third replaced by its negative, each fifth deleted."""
    v = _vectors(spark, sf_dir).select("vec_id", "embedding")
    c = Collection.create(spark, "vectors", 64)
    c.insert(v)
    c.upsert(v.where("vec_id % 3 = 0").select("vec_id", F.transform("embedding", lambda x: -x).alias("embedding")))
    c.delete(v.where("vec_id % 5 = 0"))
    return Collection.open(spark, c.root, 64)


@query("SELECT vec_id, round(CASE WHEN vec_id % 3 = 0 THEN -embedding[1]::DOUBLE ELSE embedding[1]::DOUBLE END, 6) AS first FROM embeddings WHERE vec_id % 5 <> 0")
def collection_all(spark, sf_dir):
    return _collection(spark, sf_dir).all().select("vec_id", F.round(F.col("embedding")[0].cast("double"), 6).alias("first"))


@query("SELECT vec_id + d AS vec_id, bool_or(d = 0 AND vec_id % 5 <> 0) AS present FROM embeddings, (VALUES (0), (1000000)) t(d) GROUP BY vec_id + d")
def collection_contains(spark, sf_dir):
    c, v = _collection(spark, sf_dir), _vectors(spark, sf_dir).select("vec_id")
    c.compact()
    return c.contains(v.union(v.select(F.col("vec_id") + 1_000_000)))


_SPHERE = "q AS (SELECT vec_id AS qid, list_transform(e, lambda x: x / n) AS q FROM u WHERE vec_id % 100 = 0), v AS (SELECT vec_id, list_transform(e, lambda x: x / n) AS e FROM u)"


@query(f"WITH u AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings), {_SPHERE}, r AS (SELECT qid, vec_id, list_distance(e, q) AS distance, row_number() OVER (PARTITION BY qid ORDER BY list_distance(e, q), vec_id) - 1 AS rank FROM v, q) SELECT qid, vec_id, round(distance, 5) AS distance, rank FROM r WHERE rank < 10")
def ivf_spherical(spark, sf_dir):
    """Lists over normalised vectors, kept and loaded again; every list and vector that the bound allows is searched."""
    unit = lambda c: V.normalized(F.col(c))
    v = _vectors(spark, sf_dir).select("vec_id", unit("embedding").alias("embedding"), "label")
    c = Collection.create(spark, "sphere", 64)
    c.save("centroids", search.label_centroids(v))
    centroids = c.load("centroids")
    q = _asked(spark, sf_dir).select("qid", unit("q").alias("q"))
    return search.ivf_search_exact(search.ivf_assign(v, centroids), q, centroids, 10, 3).withColumn("distance", F.round("distance", 5))


def _recall(spark, sf_dir, found: DataFrame, metric: str, least: float) -> DataFrame:
    truth = search.knn_batched(_vectors(spark, sf_dir), _asked(spark, sf_dir), 10, metric)
    return search.recall(found, truth, 10).select((F.col("recall") >= least).alias("enough"))


@query("SELECT true AS enough")
def recall_hnsw(spark, sf_dir):
    """Recall@10 of graphs for each metric is 0.9 or more."""
    v, q = _vectors(spark, sf_dir), _asked(spark, sf_dir)
    each = [_recall(spark, sf_dir, search.hnsw_query(search.hnsw_build(v, m), v, q, 10, m), m, 0.9) for m in ("l2", "cosine", "inner_product")]
    return each[0].union(each[1]).union(each[2]).agg(F.min("enough").alias("enough"))


@query("SELECT true AS enough")
def recall_ivf_pq(spark, sf_dir):
    """Lists and codes together: recall@10 above 0.5."""
    v = _vectors(spark, sf_dir)
    c, book = search.label_centroids(v), search.pq_train(v, 8, 64)
    found = search.ivf_pq_search(search.ivf_assign(v, c), search.pq_encode(v, book), _asked(spark, sf_dir), c, book, 10, 10, 20)
    return _recall(spark, sf_dir, found, "l2", 0.5)


@query("SELECT count(*) AS nodes, true AS linked FROM embeddings")
def hnsw_stats(spark, sf_dir):
    """Nodes of all graphs, and whether level 0 has between 1 and 32 links a node."""
    s = search.hnsw_levels(search.hnsw_build(_vectors(spark, sf_dir))).where("level = 0")
    return s.agg(F.sum("nodes").alias("nodes"), F.min((F.col("links") / F.col("nodes")).between(1, 32)).alias("linked"))


@query("SELECT unnest(['l2', 'l2_squared', 'cosine', 'inner_product']) AS metric, unnest([false, false, true, true]) AS is_similarity")
def metric_is_similarity(spark, sf_dir):
    return spark.createDataFrame([(m, V.is_similarity(m)) for m in V.METRICS], "metric string, is_similarity boolean")


# streams ---------------------------------------------------------------------------------------------------------


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_late_drop(spark, sf_dir):
    """Events of a second batch that are a day behind the watermark are dropped; those of the first all count."""
    return windows.late_drop(spark, sf_dir)


@query()
def stream_cooldown(spark, sf_dir):
    """Fired events by keyed state; the same as the batch operator (tests)."""
    return windows.cooldown(spark, sf_dir, 3_600_000_000)


@query("SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i FROM events")
def running_number(spark, sf_dir):
    return numbered(_events(spark, sf_dir), ["event_type"], ["event_id"], "i").select("event_id", "i")
