"""The reference's own cases: sessions, vectors, graph recall, placement, integrity, state."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import compat
from tessera.functions import vector as V
from tessera.operators import detect, placement, search
from tessera.plans.session import Session


@pytest.fixture
def users(spark):
    s = Session(spark)
    assert s.execute("CREATE TABLE users (id INT, name VARCHAR(20), age INT)").success
    assert s.execute("INSERT INTO users VALUES (1, 'Alice', 25), (2, 'Bob', 30), (3, 'Charlie', 25)").affected == 3
    return s


def test_select_update_delete(users):
    assert [tuple(r) for r in users.execute("SELECT name FROM users WHERE age = 25 AND id > 1").rows()] == [("Charlie",)]
    assert users.execute("UPDATE users SET age = age + 1 WHERE id = 1").affected == 1
    assert users.execute("DELETE FROM users WHERE id = 2").affected == 1
    assert sorted((r.id, r.age) for r in users.execute("SELECT * FROM users").rows()) == [(1, 26), (3, 25)]
    assert [r.id for r in users.execute("SELECT id FROM users ORDER BY id LIMIT 1 OFFSET 1").rows()] == [3]


def test_transactions_and_errors(users):
    users.execute("BEGIN")
    users.execute("DELETE FROM users")
    users.execute("ROLLBACK")
    assert users.execute("SELECT count(*) AS n FROM users").rows()[0].n == 3
    assert not users.execute("SELECT * FROM nowhere").success
    assert not users.execute("UPDATE users SET nope = 1").success
    assert not users.execute("CREATE TABLE users (id INT)").success
    users.autocommit = False
    users.execute("DELETE FROM users WHERE id = 1")
    users.execute("ROLLBACK")
    assert users.execute("SELECT count(*) AS n FROM users").rows()[0].n == 3


def test_not_null_is_checked(spark):
    s = Session(spark)
    s.execute("CREATE TABLE k (id INT NOT NULL)")
    assert not s.execute("INSERT INTO k VALUES (NULL)").success


def test_compat_logic(spark):
    df = spark.createDataFrame([(1, "a.b"), (None, "A.B")], "x int, s string")
    assert df.where(~compat.known(F.col("x") == 1)).count() == 1
    assert df.where(compat.like(F.col("s"), "a%", compat=True)).count() == 2


def test_distances(spark):
    r = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0], [6.0, 8.0])], "a array<float>, z array<float>, b array<float>").select(V.l2(F.col("a"), F.col("z")).alias("l"), V.cosine(F.col("a"), F.col("z")).alias("c0"), V.cosine(F.col("a"), F.col("b")).alias("c"), V.normalized(F.col("z")).alias("n")).first()
    assert (r.l, r.c0, round(r.c, 9), r.n) == (5.0, 1.0, 0.0, [0.0, 0.0])


@pytest.fixture(scope="module")
def cloud(spark):
    x = np.random.default_rng(42).standard_normal((1000, 64))
    v = spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(x)], "vec_id long, embedding array<float>").cache()
    q = spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(np.random.default_rng(7).standard_normal((50, 64)))], "qid long, q array<float>").cache()
    return v, q, search.knn_batched(v, q, 10).cache()


def test_graph_recall(cloud):
    v, q, truth = cloud
    assert search.recall(search.hnsw_search(v, q, 10, 16, 200, 100), truth, 10).first().recall > 0.9


def test_ivf_recall(cloud):
    v, q, truth = cloud
    c = search.kmeans_centroids(v, 32)
    assert search.recall(search.ivf_search(search.ivf_assign(v, c), q, c, 10, 8), truth, 10).first().recall > 0.5


def test_pq_recall(cloud):
    v, q, truth = cloud
    book = search.pq_codebook(v, 8, 256)
    assert search.recall(search.pq_search(v, search.pq_encode(v, book), q, book, 10), truth, 10).first().recall > 0.5
    assert search.compression(128, 8, 256) == 64


def test_erasure_never_lies(spark):
    o = spark.createDataFrame([(1, bytearray(b"hello world")), (2, bytearray(b""))], "object_id long, data binary")
    sh = placement.erasure_encode(o)
    one = placement.erasure(sh.withColumn("data", F.when(F.col("shard") != 1, F.col("data")))).collect()
    assert {r.object_id: bytes(r.data) for r in one} == {1: b"hello world", 2: b""}
    assert {r.data for r in placement.erasure(sh.withColumn("data", F.when(~F.col("shard").isin(0, 1), F.col("data")))).collect()} == {None}


@pytest.mark.parametrize("n", range(1, 9))
def test_merkle_proofs_hold_for_every_leaf(spark, n):
    import hashlib

    h = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(n)]
    leaves = spark.createDataFrame(list(enumerate(h)), "idx long, h string").coalesce(1).cache()
    root = placement.merkle_levels(leaves)[-1].first().h
    i = n - 1
    assert placement.merkle_verify(h[i], placement.merkle_proof(leaves, i), root)


def test_cooldown_and_segments(spark):
    e = spark.createDataFrame([(i, 1, t) for i, t in enumerate([0, 6, 11, 12, 25])], "event_id long, k int, us long")
    assert [r.event_id for r in placement.cooldown(e, "k", "us", 10).where("fired").orderBy("us").collect()] == [0, 2, 4]
    s = spark.createDataFrame([(0, i, 14) for i in range(50)], "part long, off long, size_bytes long")
    assert {r.segment_id for r in placement.segments(s, 100).collect()} == set(range(7))


def test_zscore(spark):
    rows = [("a", i, 50.0 + i % 10) for i in range(100)] + [("a", 100, 99.0), ("b", 0, 1.0), ("b", 1, 9.0)] + [("c", i, 5.0) for i in range(30)]
    got = detect.zscore(spark.createDataFrame(rows, "k string, o long, v double"), "k", "o", "v").where("anomalous").collect()
    assert [(r.k, r.o) for r in got] == [("a", 100)]


def test_first_fit_decreasing(spark):
    jobs = spark.createDataFrame([(1, 0, 1, 50), (2, 0, 1, 80), (3, 0, 1, 60), (4, 0, 9, 1)], "job_id long, pool long, cpu long, memory long")
    nodes = spark.createDataFrame([(0, 0, 4, 100), (1, 0, 4, 120)], "node_id long, pool long, cpu long, memory long")
    assert {r.job_id: r.node_id for r in placement.first_fit_decreasing(jobs, nodes).collect()} == {2: 0, 3: 1, 1: 1, 4: None}


def test_no_rule_is_dropped_beyond_the_broadcast_check(spark):
    from tessera.session import small_side

    assert small_side(spark.range(12), 10).count() == 12
    sample = spark.createDataFrame([(1, 50.0)], "event_id long, value double")
    rule = spark.range(10_002).selectExpr("cast(id as string) rule_id", "'gt' cmp", "cast(if(id = 10001, 10, 99) as double) threshold")
    assert [r.rule_id for r in detect.alerts(sample, rule).collect()] == ["10001"]


def test_queries_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "QUERY_BLOCK", 4)
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "vec_id long, embedding array<float>")
    q = v.selectExpr("vec_id AS qid", "embedding AS q")
    for f in (search.knn, search.knn_batched, search.hnsw_search):
        assert {r.qid: r.vec_id for r in f(v, q, 1).collect()} == {i: i for i in range(20)}


def test_cosine_pairs_by_matrix(spark, monkeypatch):
    """Every pair as the expression gives it, odd vectors too, and none of the plain ones by the expression."""
    monkeypatch.setattr(search, "QUERY_BLOCK", 8)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=3)]) for i in range(40)]
    rows += [(40, [0.0] * 3), (41, None), (42, [1.0, None, 2.0]), (43, [1.0, 2.0]), (44, [float("nan"), 1.0, 1.0]), (45, []), (None, [1.0, 2.0, 3.0]), (3, [1e30, -1e30, 0.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = v.where("vec_id % 4 = 0 OR vec_id > 40").selectExpr("vec_id AS qid", "embedding AS q")
    key = lambda r: tuple(str(None if x is None else round(x, 9) + 0.0) for x in r)
    want = v.crossJoin(q).select("qid", "vec_id", V.cosine(F.col("embedding"), F.col("q")).alias("d"))
    assert sorted(map(key, search.cosine_pairs(v, q).collect())) == sorted(map(key, want.collect()))
    few = v.where("vec_id < 40")
    monkeypatch.setattr(V, "cosine", lambda a, b: F.raise_error(F.lit("by row")).cast("double"))
    assert len(search.cosine_pairs(few, few.selectExpr("vec_id AS qid", "embedding AS q")).collect()) == 41 * 41
    assert search.cosine_pairs(few, few.selectExpr("vec_id AS qid", "embedding AS q").limit(0)).count() == 0


def test_searches_by_matrix_equal_expressions(spark, monkeypatch):
    """Ties, copies, blocks and small matrices: neighbours and lists as the expressions give them, which pair nothing here."""
    monkeypatch.setattr(search, "QUERY_BLOCK", 16)
    monkeypatch.setattr(search, "MATRIX", 100)
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 8)]) for i in range(300)] + [(300 + i, [1.0] * 8) for i in range(40)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    q = v.where("vec_id % 10 = 0").selectExpr("vec_id AS qid", "embedding AS q")
    c = v.where("vec_id % 50 = 7").selectExpr("cast(vec_id AS int) AS cluster_id", "embedding AS centroid")
    near = lambda df: sorted((r.qid, r["rank"], r.vec_id, round(r.distance, 6)) for r in df.collect())
    want = near(search.knn(v, q, 7))
    lists = {r.vec_id: (r.cluster_id, round(r.centroid_distance, 6)) for r in search._assign_by_row(v, c).collect()}
    book = search.pq_codebook(v, 4, 16)
    assigned = search.ivf_assign(v, c)
    assert {r.vec_id: (r.cluster_id, round(r.centroid_distance, 6)) for r in assigned.collect()} == lists
    for m in ("l2_squared", "cosine", "inner_product"):
        assert [x[:2] for x in near(search.knn_batched(v, q, 7, m))] == [x[:2] for x in want]
    monkeypatch.setattr(search, "_knn_block", None)
    monkeypatch.setattr(search, "_ivf_block", None)
    monkeypatch.setattr(search, "_pq_block", None)
    assert near(search.knn_batched(v, q, 7)) == near(search.ivf_search_exact(assigned, q, c, 7, 2)) == near(search.pq_search_exact(v, q, book, 7)) == want
    odd = spark.createDataFrame([(1, [0.0] * 8), (2, None)], v.schema)
    assert search.ivf_assign(odd, c).count() == 2 and search.ivf_assign(v.limit(0), c.limit(0)).count() == 0


def test_merkle_check_of_all_leaves(spark):
    leaves = spark.range(21).selectExpr("id AS idx", "sha2(cast(id as string), 256) AS h")
    assert [r.ok for r in placement.merkle_check(leaves).collect()] == [True] * 21


def test_all_query_vectors_are_answered(spark):
    from tessera.plans import registry

    sf = "/root/testdata/sf0.001"
    v = spark.read.parquet(f"{sf}/embeddings.parquet")
    n, q = v.count(), {r.vec_id for r in v.where("vec_id % 100 = 0").collect()}
    for name in ("pq_adc_all", "vec_l2_all", "vec_l2_sq_all", "vec_cosine_all", "vec_cosine_sim_all", "vec_ip_all"):
        got = registry.QUERIES[name](spark, sf).groupBy("qid").count().collect()
        assert {r.qid for r in got} == q and {r["count"] for r in got} == {n}


def test_pq_exact_finds_all(cloud):
    v, q, truth = cloud
    book = search.pq_train(v, 8, 16)
    assert search.recall(search.pq_search_exact(v, q, book, 10), truth, 10).first().recall == 1.0
    assert search.pq_search_exact(v.limit(3), q, book, 10).count() == 150  # fewer vectors than k: all of them
    assert book.groupBy("m").count().where("count = 16").count() == 8

    x = np.array(v.toPandas()["embedding"].tolist())

    def error(b):
        subs = b.toPandas()
        return sum(((x[:, None, m * 8 : m * 8 + 8] - np.array(subs[subs.m == m]["sub"].tolist())[None]) ** 2).sum(2).min(1).sum() for m in range(8))

    assert error(book) < 0.95 * error(search.pq_codebook(v, 8, 16))


def test_ivf_exact_finds_all(spark, cloud):
    from tessera.plans import registry

    v, q, truth = cloud
    c = search.kmeans_centroids(v, 32)
    a = search.ivf_assign(v, c)
    assert search.recall(search.ivf_search_exact(a, q, c, 10, 1), truth, 10).first().recall == 1.0
    assert search.ivf_search_exact(a.limit(3), q, c, 10, 1).count() == 150
    got = {r.search: r.recall for r in registry.QUERIES["recall_by_search"](spark, "/root/testdata/sf0.01").collect()}
    assert min(got[n] for n in ("ivf_search", "ivf_kmeans_search", "pq_search_rerank")) == 1.0
    assert got["hnsw_search"] >= 0.9


def test_crc32_of_objects(spark):
    import zlib

    from tessera.plans import systems

    sf = "/root/testdata/sf0.001"
    text = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert all(r.crc32 == zlib.crc32(text[r.object_id]) for r in systems.obj_crc32(spark, sf).collect())


def test_cooldown_stream_equals_batch(spark):
    from tessera.plans import engine, systems

    sf = "/root/testdata/sf0.001"
    assert {r.event_id for r in systems.stream_cooldown(spark, sf).collect()} == {r.event_id for r in engine.detect_cooldown(spark, sf).where("fired").collect()}


def test_running_over_hot_and_null_keys(spark):
    from tessera.operators import running

    rows = [(None if i % 5 == 0 else "hot", i, None if i % 7 == 0 else i % 11) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, i long, v long").repartition(7)
    got = {(r.k, r.i): (r.s, r.m) for r in running.running(running.running(df, ["k"], ["i"], F.col("v"), "sum", "s"), ["k"], ["i"], F.col("v"), "max", "m").collect()}
    total, top = {}, {}
    for k, i, v in sorted(rows, key=lambda r: r[1]):
        total[k] = total.get(k, 0) + (v or 0)
        top[k] = v if top.get(k) is None else top[k] if v is None else max(top[k], v)
        assert got[k, i] == (total[k], top[k])
    assert running.numbered(df.limit(0), ["k"], ["i"]).count() == 0


def test_rolling_crosses_segments(spark, monkeypatch):
    from tessera.operators import running

    monkeypatch.setattr(running, "SEGMENT", 64)
    values = [float((i * 37) % 101) for i in range(500)]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], "k string, i long, v double").repartition(3)
    for r in running.rolling(df, "k", "i", "v", 50).collect():
        w = values[max(0, r.i - 50) : r.i]
        assert r.n == len(w)
        if w:
            m = sum(w) / len(w)
            assert abs(r["mean"] - m) < 1e-9 and abs(r.sd - (sum((x - m) ** 2 for x in w) / len(w)) ** 0.5) < 1e-7


def test_bin_packing_and_gangs_against_plain_loops(spark):
    from tessera.operators import placement

    jobs = [(i, i % 2, 1 + i * 7 % 5, 64 + i * 31 % 200) for i in range(40)]
    nodes = [(n, n % 2, 8, 400) for n in range(12)]
    got = {r.job_id: r.node_id for r in placement.first_fit_decreasing(spark.createDataFrame(jobs, "job_id long, pool long, cpu long, memory long"), spark.createDataFrame(nodes, "node_id long, pool long, cpu long, memory long")).collect()}
    for pool in (0, 1):
        free = {n: [c, m] for n, p, c, m in nodes if p == pool}
        for j, _, c, m in sorted((x for x in jobs if x[1] == pool), key=lambda x: (-x[3], x[0])):
            spot = next((n for n in sorted(free) if free[n][0] >= c and free[n][1] >= m), None)
            if spot is not None:
                free[spot][0] -= c
                free[spot][1] -= m
            assert got[j] == spot
    gpus = [(g, 0, g // 4, g % 5 != 0) for g in range(16)]
    wants = [(0, 0, 2, False), (1, 0, 4, False), (2, 0, 3, True), (3, 0, 9, True), (4, 0, 1, True)]
    placed = {r.job_id: r.gpu_ids for r in placement.gang(spark.createDataFrame(wants, "job_id long, pool long, gpus int, cross_numa boolean"), spark.createDataFrame(gpus, "gpu_id long, pool long, numa int, healthy boolean")).collect()}
    healthy = {g: numa for g, _, numa, ok in gpus if ok}
    assert placed[0] is not None and len({healthy[g] for g in placed[0]}) == 1
    used = [g for v in placed.values() if v is not None for g in v]
    assert len(used) == len(set(used)) and set(used) <= set(healthy)
    held = False
    for j, _, n, _ in wants:  # the first that cannot be placed holds those behind it
        held |= placed[j] is None
        assert (placed[j] is None) == held and (held or len(placed[j]) == n)


def test_collection_reopens_and_keeps_indexes(spark):
    import pytest

    from tessera.operators.collection import Collection

    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(6)], "vec_id long, embedding array<float>")
    c = Collection.create(spark, "t", 2)
    assert c.all().count() == 0
    c.insert(v)
    with pytest.raises(ValueError):
        c.insert(v.limit(1))
    with pytest.raises(Exception):
        c.upsert(spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>"))
    c.delete(v.where("vec_id = 2"))
    c.upsert(spark.createDataFrame([(2, [9.0, 9.0]), (7, [7.0, 7.0])], "vec_id long, embedding array<float>"))
    c.delete(v.where("vec_id = 3"))
    want = {0, 1, 2, 4, 5, 7}
    for k in (c, Collection.open(spark, c.root, 2)):
        assert {r.vec_id for r in k.all().collect()} == want
    c.compact()
    again = Collection.open(spark, c.root, 2)
    assert len(again.changes) == 1 and {r.vec_id: list(r.embedding) for r in again.get(v.where("vec_id < 3")).collect()} == {0: [0.0, 1.0], 1: [1.0, 1.0], 2: [9.0, 9.0]}
    c.save("codes", v)
    assert again.load("codes").count() == 6


def test_graph_survives_freezing():
    from tessera.operators.search import Graph

    x = np.random.default_rng(1).normal(size=(300, 8)).astype(np.float32).astype(np.float64)
    g = Graph(8, 40).build(x)
    h = Graph.thawed(g.frozen())
    assert all(g.search(q, 5, 40) == h.search(q, 5, 40) for q in x[:20])
