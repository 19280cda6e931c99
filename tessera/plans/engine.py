"""Queries over the engine's operators: vectors, detection, telemetry, policies, sessions, placement, streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import vector as V
from tessera.operators import detect, placement, search
from tessera.operators.running import as_of, numbered
from tessera.plans.session import Session
from tessera.session import written
from tessera.sources.tables import table
from tessera.streaming import windows

QUERIES: dict = {}
ORACLE: dict = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


# sessions --------------------------------------------------------------------------------------------------------


def _session(spark: SparkSession, sf_dir: str, *names: str) -> Session:
    s = Session(spark)
    for n in names:
        s.register(n, table(s.spark, sf_dir, n))
    return s


def _after(name: str, statements: list[str], tables: tuple[str, ...], result: str, oracle: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = _session(spark, sf_dir, *tables)
        for r in s.execute_many(statements):
            if not r.success:
                raise ValueError(r.message)
        return s.execute(result).df

    QUERIES[name], ORACLE[name] = run, oracle


_after("dml_insert", ["INSERT INTO region VALUES (5, 'ATLANTIS'), (6, NULL)", "INSERT INTO region (r_regionkey) VALUES (7)"], ("region",), "SELECT * FROM region", "SELECT * FROM region UNION ALL SELECT 5, 'ATLANTIS' UNION ALL SELECT 6, NULL UNION ALL SELECT 7, NULL")
_after("dml_insert_select", ["INSERT INTO region SELECT n_nationkey + 100, n_name FROM nation WHERE n_regionkey = 1"], ("region", "nation"), "SELECT * FROM region", "SELECT * FROM region UNION ALL SELECT n_nationkey + 100, n_name FROM nation WHERE n_regionkey = 1")
_after("dml_update", ["UPDATE nation SET n_name = 'X', n_regionkey = n_regionkey + 1 WHERE n_nationkey < 5"], ("nation",), "SELECT * FROM nation", "SELECT n_nationkey, CASE WHEN n_nationkey < 5 THEN 'X' ELSE n_name END AS n_name, CASE WHEN n_nationkey < 5 THEN n_regionkey + 1 ELSE n_regionkey END AS n_regionkey FROM nation")
_after("dml_update_all", ["UPDATE region SET r_name = 'all'"], ("region",), "SELECT * FROM region", "SELECT r_regionkey, 'all' AS r_name FROM region")
_after("dml_delete", ["DELETE FROM nation WHERE n_regionkey = 2"], ("nation",), "SELECT * FROM nation", "SELECT * FROM nation WHERE n_regionkey <> 2")
_after("dml_delete_all", ["DELETE FROM region"], ("region",), "SELECT * FROM region", "SELECT * FROM region WHERE false")
_after("txn_commit", ["BEGIN", "DELETE FROM region WHERE r_regionkey = 0", "COMMIT"], ("region",), "SELECT * FROM region", "SELECT * FROM region WHERE r_regionkey <> 0")
_after("txn_rollback", ["BEGIN", "DELETE FROM region WHERE r_regionkey = 0", "UPDATE region SET r_name = 'gone'", "ROLLBACK"], ("region",), "SELECT * FROM region", "SELECT * FROM region")
_after("ddl_create_drop", ["CREATE TABLE t (id INT PRIMARY KEY, name VARCHAR(20))", "INSERT INTO t VALUES (1, 'a'), (2, 'b')", "CREATE TABLE IF NOT EXISTS t (id INT)", "CREATE TABLE u (x INT)", "DROP TABLE u", "DROP TABLE IF EXISTS u"], (), "SELECT * FROM t", "SELECT 1 AS id, 'a' AS name UNION ALL SELECT 2, 'b'")

# vectors ---------------------------------------------------------------------------------------------------------

EVERY, TOP = 100, 10  # one vector in a hundred is a query
_Q = f"q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % {EVERY} = 0), v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings)"
_DIST = {"l2": "list_distance(e, q)", "cosine": "1 - greatest(-1, least(1, list_cosine_similarity(e, q)))", "inner_product": "-list_inner_product(e, q)"}


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))


def _pairwise(name: str, f, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        v = _vectors(spark, sf_dir)
        return search.in_blocks(_queries(spark, sf_dir), lambda q: v.join(F.broadcast(q)).select("qid", "vec_id", F.round(f(F.col("embedding"), F.col("q")), 6).alias("d")))

    QUERIES[name], ORACLE[name] = run, f"WITH {_Q} SELECT qid, vec_id, round({sql}, 6) AS d FROM v, q"


_pairwise("vec_l2", V.l2, "list_distance(e, q)")
_pairwise("vec_l2_sq", V.l2_squared, "pow(list_distance(e, q), 2)")
_pairwise("vec_ip", V.negative_dot, _DIST["inner_product"])


@query(f"WITH {_Q} SELECT qid, vec_id, round({_DIST['cosine']}, 6) AS d FROM v, q")
def vec_cosine(spark, sf_dir):
    return search.cosine_pairs(_vectors(spark, sf_dir), _queries(spark, sf_dir)).select("qid", "vec_id", F.round("distance", 6).alias("d"))


@query(f"WITH {_Q} SELECT qid, vec_id, round(greatest(-1, least(1, list_cosine_similarity(e, q))), 6) AS d FROM v, q")
def vec_cosine_sim(spark, sf_dir):
    return search.cosine_pairs(_vectors(spark, sf_dir), _queries(spark, sf_dir)).select("qid", "vec_id", F.round(1 - F.col("distance"), 6).alias("d"))


@query(f"WITH {_Q} SELECT vec_id, round(sqrt(list_inner_product(e, e)), 6) AS n FROM v")
def vec_norm(spark, sf_dir):
    return _vectors(spark, sf_dir).select("vec_id", F.round(V.norm(F.col("embedding")), 6).alias("n"))


@query(f"WITH {_Q}, n AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS u FROM v) SELECT vec_id, round(u[1], 6) AS first, round(list_sum(u), 5) AS total FROM n")
def vec_normalize(spark, sf_dir):
    u = V.normalized(F.col("embedding"))
    return _vectors(spark, sf_dir).select("vec_id", u.alias("u")).select("vec_id", F.round(F.col("u")[0], 6).alias("first"), F.round(F.aggregate("u", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


def _knn_sql(metric: str) -> str:
    return f"WITH {_Q}, d AS (SELECT qid, vec_id, {_DIST[metric]} AS distance FROM v, q), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, vec_id) - 1 AS rank FROM d) SELECT qid, vec_id, round(distance, 5) AS distance, rank FROM r WHERE rank < {TOP}"


def _knn(name: str, metric: str, f) -> None:
    QUERIES[name] = lambda spark, sf_dir: f(_vectors(spark, sf_dir), _queries(spark, sf_dir), TOP, metric).withColumn("distance", F.round("distance", 5))
    ORACLE[name] = _knn_sql(metric)


_knn("knn_flat_l2", "l2", search.knn)
_knn("knn_flat_cosine", "cosine", search.knn)
_knn("knn_flat_ip", "inner_product", search.knn)
_knn("knn_ground_truth", "l2", search.knn_batched)
_knn("knn_batch_cosine", "cosine", search.knn_batched)
_knn("knn_batch_ip", "inner_product", search.knn_batched)

_CENT = "c AS (SELECT label AS cluster_id, list(x ORDER BY pos) AS c FROM (SELECT label, pos, round(avg(x), 6) AS x FROM (SELECT label, unnest(e) AS x, unnest(range(0, len(e))) AS pos FROM v) GROUP BY label, pos) GROUP BY label), a AS (SELECT vec_id, e, arg_min(cluster_id, (d, cluster_id)) AS cluster_id FROM (SELECT vec_id, e, cluster_id, list_distance(e, c) AS d FROM v, c) GROUP BY vec_id, e)"
_PROBE = "p AS (SELECT * FROM (SELECT qid, q, cluster_id, row_number() OVER (PARTITION BY qid ORDER BY list_distance(q, c), cluster_id) - 1 AS rank FROM q, c) WHERE rank < 3)"


@query(f"WITH {_Q}, {_CENT} SELECT vec_id, cluster_id FROM a")
def ivf_assign(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return search.ivf_assign(v, search.label_centroids(v)).select("vec_id", "cluster_id")


@query(f"WITH {_Q}, {_CENT}, {_PROBE} SELECT qid, cluster_id, rank FROM p")
def ivf_probe(spark, sf_dir):
    return search.ivf_probe(_queries(spark, sf_dir), search.label_centroids(_vectors(spark, sf_dir)), 3).select("qid", "cluster_id", "rank")


@query(f"WITH {_Q}, {_CENT}, n AS (SELECT c.cluster_id, count(a.vec_id) AS n FROM c LEFT JOIN a USING (cluster_id) GROUP BY c.cluster_id) SELECT count(*) AS lists, CAST(sum((n > 0)::INT) AS BIGINT) AS used, min(n) AS least, max(n) AS most, round(avg(n), 6) AS mean FROM n")
def ivf_stats(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    c = search.label_centroids(v)
    return search.ivf_stats(search.ivf_assign(v, c), c)


@query()
def ivf_kmeans_search(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    lists, probes = search.ivf_parameters(v.count())
    c = search.kmeans_centroids(v, lists)
    return search.ivf_search_exact(search.ivf_assign(v, c), _queries(spark, sf_dir), c, TOP, probes)


@query(_knn_sql("l2"))
def ivf_search(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    c = search.label_centroids(v)
    return search.ivf_search_exact(search.ivf_assign(v, c), _queries(spark, sf_dir), c, TOP, 3).withColumn("distance", F.round("distance", 5))


@query("SELECT 1.0 AS recall")
def recall_at_k(spark, sf_dir):
    """The least recall of the searches that prove their result (inverted file, product quantisation) against brute force."""
    return _recalls(spark, sf_dir, "ivf_search", "ivf_kmeans_search", "pq_search_rerank").agg(F.min("recall").alias("recall"))


@query()
def recall_by_search(spark, sf_dir):
    """search, recall: of every registered inverted file, product quantisation and graph search against brute force."""
    return _recalls(spark, sf_dir, "ivf_search", "ivf_kmeans_search", "pq_search_rerank", "hnsw_search")


def _recalls(spark, sf_dir, *names: str) -> DataFrame:
    truth = written(search.knn_batched(_vectors(spark, sf_dir), _queries(spark, sf_dir), TOP), "truth")
    each = [search.recall(QUERIES[n](spark, sf_dir), truth, TOP).select(F.lit(n).alias("search"), "recall") for n in names]
    return reduce(DataFrame.unionByName, each)


PARTS, CODES = 8, 16
_PQ = f"b AS (SELECT m, code, list_slice(e, m * 8 + 1, m * 8 + 8) AS sub FROM (SELECT e, row_number() OVER (ORDER BY vec_id) - 1 AS code FROM (SELECT * FROM v ORDER BY vec_id LIMIT {CODES})), (SELECT range AS m FROM range(0, {PARTS}))), k AS (SELECT vec_id, m, arg_min(code, (pow(list_distance(list_slice(e, m * 8 + 1, m * 8 + 8), sub), 2), code)) AS code FROM v JOIN b ON true GROUP BY vec_id, m), adc AS (SELECT qid, vec_id, sum(pow(list_distance(list_slice(q, m * 8 + 1, m * 8 + 8), sub), 2)) AS distance FROM k JOIN b USING (m, code), q GROUP BY qid, vec_id)"


def _coded(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    book = search.pq_codebook(v, PARTS, CODES)
    return v, book, search.pq_encode(v, book)


@query(f"WITH {_Q}, {_PQ} SELECT vec_id, string_agg(code::VARCHAR, '-' ORDER BY m) AS codes FROM k GROUP BY vec_id")
def pq_encode(spark, sf_dir):
    return _coded(spark, sf_dir)[2].select("vec_id", F.array_join(F.transform("codes", lambda c: c.cast("string")), "-").alias("codes"))


@query(f"WITH {_Q}, {_PQ} SELECT vec_id, round(sum(list_sum(sub)), 5) AS total FROM k JOIN b USING (m, code) GROUP BY vec_id")
def pq_decode(spark, sf_dir):
    _, book, coded = _coded(spark, sf_dir)
    return search.pq_decode(coded, book).select("vec_id", F.round(F.aggregate("decoded", F.lit(0.0), lambda a, x: a + x.cast("double")), 5).alias("total"))


@query(f"WITH {_Q}, {_PQ} SELECT qid, vec_id, round(distance, 5) AS distance FROM adc")
def pq_adc(spark, sf_dir):
    _, book, coded = _coded(spark, sf_dir)
    return search.in_blocks(_queries(spark, sf_dir), lambda q: search.pq_adc(coded, q, book)).withColumn("distance", F.round("distance", 5))


@query(_knn_sql("l2"))
def pq_search_rerank(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return search.pq_search_exact(v, _queries(spark, sf_dir), search.pq_train(v, PARTS, CODES), TOP).withColumn("distance", F.round("distance", 5))


@query()
def hnsw_search(spark, sf_dir):
    return search.hnsw_search(_vectors(spark, sf_dir), _queries(spark, sf_dir), TOP)


# detection and telemetry -----------------------------------------------------------------------------------------

_MATCH = "m AS (SELECT event_id, r.* FROM events e JOIN (" + detect.RULES_SQL + ") r ON r.enabled AND r.pattern <> '' AND contains(concat_ws(' ', e.event_type, e.user_id::VARCHAR, e.props), r.pattern))"


@query(f"WITH {_MATCH} SELECT event_id, rule_id, threshold AS score FROM m")
def detect_rule_match(spark, sf_dir):
    return detect.matches(table(spark, sf_dir, "events"), detect.rules(spark)).select("event_id", "rule_id", F.col("threshold").alias("score"))


_BEST = f"{_MATCH}, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY threshold DESC, rule_ord) AS rn FROM m) WHERE rn = 1 AND threshold >= 0.8)"


@query(f"WITH {_BEST} SELECT event_id, rule_id, threshold AS score, severity FROM best")
def detect_best_rule(spark, sf_dir):
    return detect.best(table(spark, sf_dir, "events"), detect.rules(spark))


@query(f"WITH {_BEST} SELECT event_id, severity, CASE severity WHEN 'CRITICAL' THEN 'kill_process' WHEN 'HIGH' THEN 'block' WHEN 'WARNING' THEN 'alert' END AS action FROM best WHERE severity <> 'INFO'")
def detect_response_route(spark, sf_dir):
    return detect.route(detect.best(table(spark, sf_dir, "events"), detect.rules(spark)))


@query('''WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE event_type = 'error'),
w AS (SELECT event_id, user_id, us, i, true AS fired, us AS since FROM e WHERE i = 1 UNION ALL
SELECT e.event_id, e.user_id, e.us, e.i, e.us - w.since >= 3600000000, CASE WHEN e.us - w.since >= 3600000000 THEN e.us ELSE w.since END FROM w JOIN e ON e.user_id = w.user_id AND e.i = w.i + 1)
SELECT event_id, user_id, us, fired FROM w''')
def detect_cooldown(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type = 'error'").select("event_id", "user_id", F.expr("unix_micros(CAST(ts AS TIMESTAMP))").alias("us"))
    return placement.cooldown(e, "user_id", "us", 3_600_000_000)


@query("SELECT event_id, event_type, n >= 10 AND sd > 0 AND abs(value - mean) / nullif(sd, 0) > 1.5 AS anomalous FROM (SELECT event_id, event_type, value, count(value) OVER w AS n, avg(value) OVER w AS mean, stddev_pop(value) OVER w AS sd FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 1000 PRECEDING AND 1 PRECEDING))")
def zscore_anomaly(spark, sf_dir):
    return detect.zscore(table(spark, sf_dir, "events"), "event_type", "event_id", "value", 1.5).select("event_id", "event_type", "anomalous")


_ALERT = "t AS (SELECT event_id, user_id AS device, epoch_us(ts) AS us, value FROM events)"


@query(f"WITH {_ALERT}, r AS (SELECT 'hot' AS rule_id, 'gt' AS cmp, 90.0 AS threshold UNION ALL SELECT 'cold', 'lt', 5.0 UNION ALL SELECT 'edge', 'gte', 99.0) SELECT event_id, rule_id FROM t JOIN r ON CASE cmp WHEN 'gt' THEN value > threshold WHEN 'gte' THEN value >= threshold WHEN 'lt' THEN value < threshold END")
def alert_threshold(spark, sf_dir):
    return detect.alerts(detect.samples(table(spark, sf_dir, "events")), detect.alert_rules(spark)).select("event_id", "rule_id")


_RUNS = f"{_ALERT}, f AS (SELECT *, value > 20 AS bad FROM t), g AS (SELECT *, sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER (PARTITION BY device ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS island FROM f), h AS (SELECT *, min(us) OVER (PARTITION BY device, island) AS since FROM g WHERE bad)"


@query(f"WITH {_RUNS} SELECT event_id, device, us - since >= 21600000000 AS firing FROM h")
def alert_duration(spark, sf_dir):
    return detect.durations(detect.samples(table(spark, sf_dir, "events")), 20.0, 21_600_000_000).select("event_id", "device", "firing")


@query(f"WITH {_RUNS} SELECT event_id, device, us FROM h WHERE us - since >= 21600000000 ORDER BY us DESC, event_id DESC LIMIT 50")
def alert_history(spark, sf_dir):
    return detect.durations(detect.samples(table(spark, sf_dir, "events")), 20.0, 21_600_000_000).where("firing").orderBy(F.desc("us"), F.desc("event_id")).limit(50).select("event_id", "device", "us")


_TREND = f"{_ALERT}, w AS (SELECT event_id, device, first_value(value) OVER p AS v0, value AS v1, (us - min(us) OVER p) / 1000000.0 AS span FROM t WINDOW p AS (PARTITION BY device ORDER BY us, event_id RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), x AS (SELECT event_id, device, v1, (v1 - v0) / greatest(span, 1) * 60 AS rate FROM w)"


def _trend(spark, sf_dir):
    return detect.trend(detect.samples(table(spark, sf_dir, "events")))


@query("WITH t AS (SELECT event_id, user_id AS device, epoch_us(ts) AS us, value FROM events), w AS (SELECT event_id, device, first_value(value) OVER p AS v0, value AS v1, (us - min(us) OVER p) / 1000000.0 AS span FROM t WINDOW p AS (PARTITION BY device ORDER BY us RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW)) SELECT event_id, device, round((v1 - v0) / greatest(span, 1) * 60, 6) AS rate, CASE WHEN abs((v1 - v0) / greatest(span, 1) * 60) < 0.1 THEN 'stable' WHEN v1 > v0 THEN 'increasing' ELSE 'decreasing' END AS direction FROM w")
def trend_window(spark, sf_dir):
    return _trend(spark, sf_dir).select("event_id", "device", F.round("rate", 6).alias("rate"), "direction")


_RISK = "WITH t AS (SELECT event_id, user_id AS device, epoch_us(ts) AS us, value FROM events), w AS (SELECT event_id, device, first_value(value) OVER p AS v0, value AS v1, (us - min(us) OVER p) / 1000000.0 AS span FROM t WINDOW p AS (PARTITION BY device ORDER BY us RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW)), r AS (SELECT *, (v1 - v0) / greatest(span, 1) * 60 AS rate FROM w), k AS (SELECT event_id, device, CASE WHEN rate < 0.1 THEN 0.0 ELSE least(1.0, least(0.95, rate / 10) * CASE WHEN (100 - v1) / (rate / 60) < 300 THEN 0.9 WHEN (100 - v1) / (rate / 60) < 600 THEN 0.6 WHEN (100 - v1) / (rate / 60) < 1800 THEN 0.3 ELSE 0.0 END) END AS risk FROM r)"


@query(f"{_RISK} SELECT event_id, device, round(risk, 6) AS risk FROM k")
def failure_risk(spark, sf_dir):
    return detect.risk(_trend(spark, sf_dir)).select("event_id", "device", F.round("risk", 6).alias("risk"))


@query(f"{_RISK} SELECT event_id, CASE WHEN risk > 0.8 THEN 'preempt' WHEN risk > 0.5 THEN 'schedule' WHEN risk > 0.2 THEN 'monitor' ELSE 'none' END AS advice FROM k")
def maintenance_reco(spark, sf_dir):
    r = detect.risk(_trend(spark, sf_dir))
    return r.select("event_id", F.when(F.col("risk") > 0.8, "preempt").when(F.col("risk") > 0.5, "schedule").when(F.col("risk") > 0.2, "monitor").otherwise("none").alias("advice"))


@query("SELECT event_id, CASE WHEN event_type = 'view' THEN 'r-view' WHEN user_id % 3 = 0 AND event_type IN ('click', 'purchase') THEN 'r-role' WHEN event_type = 'error' THEN 'r-deny' WHEN user_id % 10 = 1 THEN 'r-acl' END AS rule_id, CASE WHEN event_type = 'view' THEN 'allow' WHEN user_id % 3 = 0 AND event_type IN ('click', 'purchase') THEN 'allow' WHEN event_type = 'error' THEN 'deny' WHEN user_id % 10 = 1 THEN 'allow' ELSE 'deny' END AS decision FROM events")
def policy_evaluate(spark, sf_dir):
    return detect.evaluate(detect.requests(table(spark, sf_dir, "events")), detect.policies(spark))


# integrity, placement --------------------------------------------------------------------------------------------


def _leaves(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("idx"), F.sha2(F.col("event_id").cast("string"), 256).alias("h"))


@query("WITH RECURSIVE m AS (SELECT event_id AS i, sha256(event_id::VARCHAR) AS h, (SELECT count(*) FROM events) AS n FROM events UNION ALL SELECT i // 2, sha256(string_agg(h, '' ORDER BY i) || CASE WHEN count(*) = 1 THEN any_value(h) ELSE '' END), (any_value(n) + 1) // 2 FROM m WHERE n > 1 GROUP BY i // 2) SELECT h AS root FROM m WHERE n = 1")
def merkle_root(spark, sf_dir):
    return placement.merkle_root(_leaves(spark, sf_dir)).select(F.col("h").alias("root"))


@query("SELECT event_id AS idx, true AS ok FROM events")
def merkle_verify(spark, sf_dir):
    return placement.merkle_check(_leaves(spark, sf_dir))


@query("SELECT doc_id AS object_id, sha256(coalesce(text, '')) AS checksum FROM documents")
def erasure_roundtrip(spark, sf_dir):
    objects = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("object_id"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"))
    shards = placement.erasure_encode(objects).withColumn("data", F.when(F.col("shard") != F.col("object_id") % 4, F.col("data")))
    return placement.erasure(shards).select("object_id", F.sha2("data", 256).alias("checksum"))


@query("SELECT event_id AS idx, event_id % 7 <> 3 AS ok FROM events")
def merkle_verify_tampered(spark, sf_dir):
    """Claims of which each seventh is wrong, against the proofs of the true leaves."""
    leaves = _leaves(spark, sf_dir)
    claims = leaves.select("idx", F.when(F.col("idx") % 7 == 3, F.sha2("h", 256)).otherwise(F.col("h")).alias("h"))
    return placement.merkle_check(leaves, claims=claims)


@query("SELECT e.event_id AS o_orderkey, arg_max(f.event_id, (f.ts, f.event_id)) AS event_id FROM events e JOIN events f ON e.user_id = f.user_id AND f.ts <= e.ts AND f.event_type = 'purchase' WHERE e.event_type = 'error' GROUP BY e.event_id")
def ext_join_asof(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    left = e.where("event_type = 'error'").select("user_id", "ts", F.col("event_id").alias("o_orderkey"))
    right = e.where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    return as_of(left, right, "user_id", "ts", "event_id", "event_id").where("event_id IS NOT NULL").select("o_orderkey", "event_id")


@query('''WITH RECURSIVE e AS (SELECT user_id % 4 AS part, row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) - 1 AS off, octet_length(encode(props))::BIGINT AS size_bytes FROM events),
w AS (SELECT part, off, size_bytes, 0::BIGINT AS segment_id, size_bytes AS used FROM e WHERE off = 0 UNION ALL
SELECT e.part, e.off, e.size_bytes, w.segment_id + (w.used >= 4096)::BIGINT, CASE WHEN w.used >= 4096 THEN 0 ELSE w.used END + e.size_bytes FROM w JOIN e ON e.part = w.part AND e.off = w.off + 1)
SELECT part, off, size_bytes, segment_id FROM w''')
def log_segments(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 4).alias("part"), "event_id", F.octet_length("props").cast("long").alias("size_bytes"))
    return placement.segments(numbered(e, ["part"], ["event_id"]), 4096)


@query()
def ffd_binpack(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    jobs = e.selectExpr("event_id AS job_id", "user_id AS pool", "CAST(1 + event_id % 4 AS BIGINT) AS cpu", "CAST(64 + event_id % 200 AS BIGINT) AS memory")
    nodes = e.select("user_id").distinct().selectExpr("explode(array(2 * user_id, 2 * user_id + 1)) AS node_id", "user_id AS pool", "CAST(16 AS BIGINT) AS cpu", "CAST(1024 AS BIGINT) AS memory")
    return placement.first_fit_decreasing(jobs, nodes)


@query()
def gang_place(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    users = e.select("user_id").distinct().selectExpr("user_id AS pool", "explode(array(2 * user_id, 2 * user_id + 1)) AS job_id")
    jobs = users.selectExpr("job_id", "pool", "CAST(1 + job_id % 4 AS INT) AS gpus", "job_id % 3 = 0 AS cross_numa")
    devices = e.selectExpr("event_id AS gpu_id", "user_id AS pool", "event_id % 2 AS numa", "event_type <> 'error' AS healthy")
    return placement.gang(jobs, devices).select("job_id", F.array_join(F.transform("gpu_ids", lambda x: x.cast("string")), ",").alias("gpus"))


# streams ---------------------------------------------------------------------------------------------------------


@query("SELECT event_type, epoch_us(date_trunc('day', ts)) AS start_us, count(*) AS n FROM events GROUP BY 1, 2")
def stream_tumbling(spark, sf_dir):
    return windows.counts(spark, sf_dir, "1 day")


@query("SELECT event_type, s AS start_us, count(*) AS n FROM (SELECT event_type, unnest([epoch_us(date_trunc('day', ts)) + (CASE WHEN hour(ts) >= 12 THEN 43200000000 ELSE 0 END), epoch_us(date_trunc('day', ts)) + (CASE WHEN hour(ts) >= 12 THEN 0 ELSE -43200000000 END)]) AS s FROM events) GROUP BY 1, 2")
def stream_sliding(spark, sf_dir):
    return windows.counts(spark, sf_dir, "1 day", "12 hours")


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM s GROUP BY user_id, k")
def stream_session(spark, sf_dir):
    return windows.sessions(spark, sf_dir, "6 hours")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark, sf_dir):
    return windows.dedup(spark, sf_dir)


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS rn FROM events) WHERE rn <= 1000 GROUP BY event_type")
def stream_stateful_baseline(spark, sf_dir):
    return windows.baseline(spark, sf_dir)
