"""Exact and approximate nearest neighbours: flat, inverted file, product quantisation, graph shards, recall."""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import vector as V
from tessera.session import ship, written

#: Query tables are sent to all tasks in blocks of this many rows.
QUERY_BLOCK = 4096
#: Vectors in one graph.
SHARD_ROWS = 50_000
#: Vectors that codebooks are trained on.
TRAIN_ROWS = 20_000
#: Slack of distance bounds for rounding.
SLACK = 1e-6
#: Pairs that a worker makes at once.
PAIR_ROWS = 1 << 17
#: Cells of one matrix of queries x vectors.
MATRIX = 1 << 20


def top(df: DataFrame, by: list[str], distance: str, tie: str, k: int) -> DataFrame:
    """The k nearest rows for each key with a rank from 0; Spark keeps k a partition before it shuffles."""
    w = Window.partitionBy(*by).orderBy(distance, tie)
    return df.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k).withColumn("rank", F.col("rank") - 1)


def knn(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """qid, vec_id, distance, rank by expressions. queries (qid, q) are sent to every task, block by block."""
    return in_blocks(queries, lambda q: _knn_block(vectors, q, k, metric))


def in_blocks(queries: DataFrame, search) -> DataFrame:
    return reduce(DataFrame.unionByName, [search(q) for q in query_blocks(queries)])


def query_blocks(queries: DataFrame) -> list[DataFrame]:
    """queries by hash of qid in blocks of about half of QUERY_BLOCK rows; up to QUERY_BLOCK rows are one block."""
    n = queries.count()
    if n <= QUERY_BLOCK:
        return [queries]
    b = -(-2 * n // QUERY_BLOCK)
    return [queries.where(F.pmod(F.xxhash64("qid"), F.lit(b)) == i) for i in range(b)]


def _knn_block(vectors: DataFrame, queries: DataFrame, k: int, metric: str) -> DataFrame:
    pairs = vectors.join(F.broadcast(queries))
    return top(pairs.select("qid", "vec_id", V.METRICS[metric](F.col("embedding"), F.col("q")).alias("distance")), ["qid"], "distance", "vec_id", k).select("qid", "vec_id", "distance", "rank")


def knn_batched(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """The same by matrix products over Arrow batches: each batch gives k rows a query, the window picks the last k."""
    return in_blocks(queries, lambda q: _knn_batched_block(vectors, q, k, metric))


def _knn_batched_block(vectors: DataFrame, queries: DataFrame, k: int, metric: str) -> DataFrame:
    return _best(vectors, queries, k, metric)


def _best(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "l2", columns: tuple = (), score=None, allowed=None) -> DataFrame:
    """qid, vec_id, distance, rank: the k nearest of one block of queries, by matrices of queries x vectors.

    score(batch) replaces the metric; allowed(batch) marks the pairs that count. batch: vec_id, embedding and `columns`. For L2
    a matrix product comes first; all that it leaves within rounding of the k-th distance are measured by differences.
    """
    q = queries.orderBy("qid").select("qid", "q").toArrow()
    if not len(q):
        return _knn_block(vectors, queries, k, "l2")
    qid, qm = q.column("qid").combine_chunks(), _matrix(q.column("q").combine_chunks())
    length, by_difference = np.linalg.norm(qm, axis=1), score is None and metric in ("l2", "l2_squared")

    def about(m: np.ndarray) -> np.ndarray:
        if metric == "inner_product":
            return -(qm @ m.T)
        if metric == "cosine":
            n = length[:, None] * np.linalg.norm(m, axis=1)
            return np.where(n == 0, 1.0, 1 - np.clip(qm @ m.T / np.where(n == 0, 1, n), -1, 1))
        return (length**2)[:, None] + (m**2).sum(1) - 2 * (qm @ m.T)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit = np.full((len(qid), 1), np.inf)  # of the vectors that this task has seen
        step = max(1, MATRIX // len(qid))
        for whole in batches:
            for at in range(0, len(whole), step):
                b = whole.slice(at, step)
                ids, m = b.column(0).to_numpy(zero_copy_only=False), _matrix(b.column(1))
                d = score(b) if score else about(m)
                order = np.where(np.isnan(d), np.inf, d)
                if allowed:
                    fits = allowed(b)
                    order = np.where(fits, order, np.inf)
                slack = 1e-12 * ((length**2)[:, None] + (m**2).sum(1).max()) if by_difference else 0.0
                if len(b) >= k:
                    limit = np.minimum(limit, np.partition(order, k - 1, axis=1)[:, k - 1 : k] + slack)
                ok = order <= limit + slack
                if allowed:
                    ok &= fits
                for i in np.flatnonzero(ok.sum(1) > k):  # ties
                    j = np.flatnonzero(ok[i])
                    near = ((m[j] - qm[i]) ** 2).sum(1) if by_difference else order[i, j]
                    ok[i, np.delete(j, np.lexsort((ids[j], near))[:k])] = False
                i, j = np.nonzero(ok)
                out = ((m[j] - qm[i]) ** 2).sum(1) if by_difference else d[i, j]
                yield pa.RecordBatch.from_arrays([qid.take(pa.array(i)), b.column(0).take(pa.array(j)), pa.array(np.sqrt(out) if by_difference and metric == "l2" else out)], names=["qid", "vec_id", "distance"])

    kinds = [queries.schema["qid"].dataType.simpleString(), vectors.schema["vec_id"].dataType.simpleString()]
    ship(vectors.sparkSession)
    part = dealt(vectors.select("vec_id", "embedding", *columns)).mapInArrow(run, "qid {}, vec_id {}, distance double".format(*kinds))
    return top(part, ["qid"], "distance", "vec_id", k).select("qid", "vec_id", "distance", "rank")


def dealt(vectors: DataFrame) -> DataFrame:
    """vectors over all cores: a small table is read as few pieces, but each row meets all queries."""
    return vectors.repartition(2 * vectors.sparkSession.sparkContext.defaultParallelism)


def _plain(column: str, dim: int):
    """Whether a vector has dim numbers, none of them null or not finite."""
    return F.coalesce((F.size(column) == dim) & F.forall(column, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    if column.null_count or len(pc.unique(pc.list_value_length(column))) > 1:
        raise ValueError("vectors must be there and of one size")
    if not len(column):
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def cosine_pairs(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """qid, vec_id, distance of every vector and query by matrix products; pairs with nulls, odd sizes or numbers that are not
    finite by the expression V.cosine."""
    return in_blocks(queries, lambda q: _cosine_block(vectors, q))


def _cosine_block(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    v = vectors.select("vec_id", "embedding")
    dim = queries.agg(F.max(F.size("q"))).first()[0] or 0
    plain = queries.where(_plain("q", dim)).select("qid", "q").toArrow()  # one block
    rest = [(v, queries.where(~_plain("q", dim))), (v.where(~_plain("embedding", dim)), queries.where(_plain("q", dim)))]
    by_row = reduce(DataFrame.unionByName, [x.join(F.broadcast(q)).select("qid", "vec_id", V.cosine(F.col("embedding"), F.col("q")).alias("distance")) for x, q in rest])
    if dim < 1 or not len(plain):
        return by_row
    qid, qm = plain.column("qid").combine_chunks(), _matrix(plain.column("q").combine_chunks())
    lengths = np.linalg.norm(qm, axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, PAIR_ROWS // len(qid))
        for whole in batches:
            for at in range(0, len(whole), step):
                b = whole.slice(at, step)
                m = _matrix(b.column(1))
                n = np.linalg.norm(m, axis=1)[:, None] * lengths
                d = np.where(n == 0, 1.0, 1 - np.clip(m @ qm.T / np.where(n == 0, 1, n), -1, 1))
                i, j = np.repeat(np.arange(len(b)), len(qid)), np.tile(np.arange(len(qid)), len(b))
                yield pa.RecordBatch.from_arrays([qid.take(pa.array(j)), b.column(0).take(pa.array(i)), pa.array(d.ravel())], names=["qid", "vec_id", "distance"])

    kinds = [queries.schema["qid"].dataType.simpleString(), v.schema["vec_id"].dataType.simpleString()]
    by_matrix = dealt(v.where(_plain("embedding", dim))).mapInArrow(run, "qid {}, vec_id {}, distance double".format(*kinds))
    return by_matrix.unionByName(by_row)


def recall(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """Mean share of each query's true k that were found."""
    hit = truth.select("qid", "vec_id").join(found.select("qid", "vec_id").distinct().withColumn("hit", F.lit(1)), ["qid", "vec_id"], "left")
    per = hit.groupBy("qid").agg((F.sum(F.coalesce("hit", F.lit(0))) / k).alias("r"))
    return per.agg(F.round(F.avg("r"), 6).alias("recall"))


# inverted file ---------------------------------------------------------------------------------------------------


def ivf_parameters(n: int, target: float = 0.9) -> tuple[int, int]:
    """Lists and probes for n vectors: the root of n; a tenth, a twentieth or a hundredth of the lists."""
    lists = max(1, int(math.sqrt(n)))
    share = 0.10 if target >= 0.95 else 0.05 if target >= 0.9 else 0.01
    return lists, max(1, int(lists * share))


def label_centroids(vectors: DataFrame) -> DataFrame:
    """Deterministic centroids: the mean of each label, rounded to 6 places."""
    cell = vectors.select("label", F.posexplode("embedding").alias("pos", "x")).groupBy("label", "pos").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("x"))
    return cell.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("centroid")).withColumnRenamed("label", "cluster_id")


def kmeans_centroids(vectors: DataFrame, k: int, seed: int = 42, rounds: int = 20) -> DataFrame:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    fit = KMeans(k=k, initMode="random", maxIter=rounds, tol=1e-6, seed=seed).fit(vectors.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features")))
    return vectors.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(fit.clusterCenters())], "cluster_id int, centroid array<double>")


def ivf_assign(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """vectors with cluster_id and centroid_distance: the nearest centroid by L2, the smaller id on ties. centroids: a small table.

    By matrices; rows with nulls, odd sizes or numbers that are not finite by expressions.
    """
    cs = centroids.orderBy("cluster_id").select("cluster_id", "centroid").toArrow()
    ids, c = cs.column("cluster_id").combine_chunks(), _matrix(cs.column("centroid").combine_chunks())
    if not c.size:
        return _assign_by_row(vectors, centroids)
    at = vectors.columns.index("embedding")
    size = (c**2).sum(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, len(whole), step := max(1, MATRIX // max(1, len(c)))):
                b = whole.slice(k, step)
                x = _matrix(b.column(at))
                d = (x**2).sum(1)[:, None] + size - 2 * (x @ c.T)
                i, j = np.nonzero(d <= d.min(1, keepdims=True) + 1e-12 * ((x**2).sum(1)[:, None] + size))
                e = ((x[i] - c[j]) ** 2).sum(1)  # those within rounding, by differences
                first = np.lexsort((j, e, i))
                first = first[np.r_[True, np.diff(i[first]) > 0]]
                yield pa.RecordBatch.from_arrays([*b.columns, ids.take(pa.array(j[first])), pa.array(np.sqrt(e[first]))], names=[*b.schema.names, "cluster_id", "centroid_distance"])

    ship(vectors.sparkSession)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema]
    plain = _plain("embedding", c.shape[1])
    out = vectors.where(plain).mapInArrow(run, ", ".join([*fields, f"cluster_id {centroids.schema['cluster_id'].dataType.simpleString()}", "centroid_distance double"]))
    return out.unionByName(_assign_by_row(vectors.where(~plain), centroids))


def _assign_by_row(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    all_c = centroids.agg(F.array_sort(F.collect_list(F.struct("cluster_id", "centroid"))).alias("cs"))
    d = vectors.join(F.broadcast(all_c))
    best = F.array_min(F.transform("cs", lambda c: F.struct(V.l2(F.col("embedding"), c["centroid"]).alias("d"), c["cluster_id"].alias("id"))))
    return d.withColumn("__b", best).select(*vectors.columns, F.col("__b.id").alias("cluster_id"), F.col("__b.d").alias("centroid_distance"))


def ivf_probe(queries: DataFrame, centroids: DataFrame, probes: int, metric: str = "l2") -> DataFrame:
    pairs = queries.join(F.broadcast(centroids)).select("qid", "q", "cluster_id", V.METRICS[metric](F.col("q"), F.col("centroid")).alias("distance"))
    return top(pairs, ["qid"], "distance", "cluster_id", probes).select("qid", "q", "cluster_id", "rank")


def ivf_search(assigned: DataFrame, queries: DataFrame, centroids: DataFrame, k: int, probes: int, metric: str = "l2") -> DataFrame:
    """Exhaustive within the probed lists. Stored partitioned by cluster_id, the join prunes the scan."""
    return in_blocks(queries, lambda q: _ivf_block(assigned, q, centroids, k, probes, metric))


def _ivf_block(assigned: DataFrame, queries: DataFrame, centroids: DataFrame, k: int, probes: int, metric: str) -> DataFrame:
    probed = ivf_probe(queries, centroids, probes, metric).select("qid", "q", "cluster_id")
    hits = assigned.join(F.broadcast(probed), "cluster_id")
    return top(hits.select("qid", "vec_id", V.METRICS[metric](F.col("embedding"), F.col("q")).alias("distance")), ["qid"], "distance", "vec_id", k).select("qid", "vec_id", "distance", "rank")


def _probed_block(assigned: DataFrame, queries: DataFrame, centroids: DataFrame, k: int, probes: int) -> DataFrame:
    """_ivf_block for L2 by matrices."""
    qid = np.array([r.qid for r in queries.orderBy("qid").select("qid").collect()])
    got = ivf_probe(queries, centroids, probes).select("qid", "cluster_id").toArrow()
    at, cluster = np.searchsorted(qid, np.asarray(got.column("qid"))), np.asarray(got.column("cluster_id"))
    names, which = np.unique(cluster, return_inverse=True)
    probed = np.zeros((len(qid), len(names) + 1), bool)
    probed[at, which] = True

    def allowed(b: pa.RecordBatch) -> np.ndarray:
        c = np.asarray(b.column(2))
        i = np.minimum(np.searchsorted(names, c), len(names) - 1)
        return probed[:, np.where(names[i] == c, i, len(names))]

    return _best(assigned, queries, k, columns=("cluster_id",), allowed=allowed)


def ivf_search_exact(assigned: DataFrame, queries: DataFrame, centroids: DataFrame, k: int, probes: int) -> DataFrame:
    """ivf_search, and then every list and vector that a distance bound cannot rule out: the k nearest (L2), proven.

    By the triangle inequality a vector is at least |query to centroid - vector to centroid| away; lists are ruled out
    by their radius, vectors by their stored centroid_distance, where that is above the query's k-th distance so far.
    """
    assigned = written(assigned.select("vec_id", "embedding", "cluster_id", "centroid_distance"), "ivf-lists")
    radii = written(assigned.groupBy("cluster_id").agg(F.min("centroid_distance").alias("near"), F.max("centroid_distance").alias("far")).join(F.broadcast(centroids), "cluster_id"), "ivf-radii")

    places = radii.select("cluster_id", "centroid", "near", "far").orderBy("cluster_id").toArrow()  # a small table
    if not len(places):
        return _knn_block(assigned, queries, k, "l2")
    names, middles = np.asarray(places.column("cluster_id").combine_chunks()), _matrix(places.column("centroid").combine_chunks())
    near, far = (np.asarray(places.column(c).combine_chunks()) for c in ("near", "far"))

    def block(q: DataFrame) -> DataFrame:
        found = kth(_probed_block(assigned, q, centroids, k, probes), q, k).orderBy("qid").select("q", "limit").toArrow()
        if not len(found):
            return _knn_block(assigned, q, k, "l2")
        limit, qm = np.asarray(found.column("limit").combine_chunks())[:, None] + SLACK, _matrix(found.column("q").combine_chunks())

        def allowed(b: pa.RecordBatch) -> np.ndarray:
            own, at = np.unique(np.searchsorted(names, np.asarray(b.column(2))), return_inverse=True)
            away = np.stack([np.sqrt(((qm - middles[c]) ** 2).sum(1)) for c in own], axis=1)
            lists = (away - far[own] <= limit) & (near[own] - away <= limit)
            return lists[:, at] & (np.abs(away[:, at] - np.asarray(b.column(3))) <= limit)

        return _best(assigned, q, k, columns=("cluster_id", "centroid_distance"), allowed=allowed)

    return in_blocks(queries, block)


def ivf_stats(assigned: DataFrame, centroids: DataFrame) -> DataFrame:
    n = centroids.select("cluster_id").join(assigned.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")), "cluster_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return n.agg(F.count(F.lit(1)).alias("lists"), F.sum((F.col("n") > 0).cast("long")).alias("used"), F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg("n"), 6).alias("mean"))


# product quantisation --------------------------------------------------------------------------------------------


def pq_codebook(vectors: DataFrame, parts: int, codes: int) -> DataFrame:
    """Deterministic codebook: the sub-vectors of the first `codes` ids. m, code, sub."""
    width = F.size("embedding") / parts
    first = vectors.orderBy("vec_id").limit(codes).withColumn("code", F.row_number().over(Window.orderBy("vec_id")) - 1)
    return first.select("code", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("m"), "embedding", width.cast("int").alias("w")).select("m", "code", F.slice("embedding", F.col("m") * F.col("w") + 1, F.col("w")).alias("sub"))


def _book(codebook: DataFrame) -> DataFrame:
    per = codebook.groupBy("m").agg(F.array_sort(F.collect_list(F.struct("code", "sub"))).alias("subs"))
    return per.agg(F.transform(F.array_sort(F.collect_list(F.struct("m", "subs"))), lambda s: s["subs"]).alias("book"))


def pq_train(vectors: DataFrame, parts: int, codes: int, sample: int = TRAIN_ROWS, rounds: int = 25, seed: int = 42) -> DataFrame:
    """Codebook by k-means in each sub-space (Lloyd, at most `rounds`), on about `sample` vectors told by a hash of their id. m, code, sub."""
    n = vectors.count()
    some = vectors.where(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_003)) * n < 1_000_003 * sample).orderBy("vec_id").select("embedding").toPandas()
    if some.empty:
        return pq_codebook(vectors, parts, codes)
    x, rng = np.array(some["embedding"].tolist(), np.float64), np.random.default_rng(seed)
    w, rows = x.shape[1] // parts, []
    for m in range(parts):
        sub = np.unique(x[:, m * w : (m + 1) * w], axis=0)
        c = sub[rng.permutation(len(sub))[:codes]]
        for _ in range(rounds):
            near = ((c**2).sum(1) - 2 * sub @ c.T).argmin(1)
            size = np.bincount(near, minlength=len(c))
            new = np.array([np.bincount(near, sub[:, d], len(c)) for d in range(w)]).T / np.maximum(size, 1)[:, None]
            new[size == 0] = c[size == 0]
            if np.allclose(new, c):
                break
            c = new
        rows += [(m, k, [float(v) for v in row]) for k, row in enumerate(c)]
    return vectors.sparkSession.createDataFrame(rows, "m int, code int, sub array<double>")


def pq_encode(vectors: DataFrame, codebook: DataFrame) -> DataFrame:
    """vec_id, codes: the nearest sub-vector of each part (smaller code on ties)."""
    d = vectors.join(F.broadcast(_book(codebook)))

    def code(subs, m):
        w = F.size(F.element_at(subs, 1)["sub"])
        part = F.slice("embedding", m * w + 1, w)
        return F.array_min(F.transform(subs, lambda s: F.struct(V.l2_squared(part, s["sub"]).alias("d"), s["code"].alias("c"))))["c"]

    return d.select("vec_id", F.transform("book", code).alias("codes"))


def pq_decode(coded: DataFrame, codebook: DataFrame) -> DataFrame:
    d = coded.join(F.broadcast(_book(codebook)))
    return d.select("vec_id", F.flatten(F.transform("codes", lambda c, m: F.element_at(F.element_at(F.col("book"), m + 1), c + 1)["sub"])).alias("decoded"))


def pq_adc(coded: DataFrame, queries: DataFrame, codebook: DataFrame) -> DataFrame:
    """qid, vec_id, distance: squared, from one table of sub-distances a query (a block of queries at most)."""
    d = coded.join(F.broadcast(_tables(queries.select("qid", "q"), codebook).drop("q")))
    return d.select("qid", "vec_id", _table_distance().alias("distance"))


def _tables(queries: DataFrame, codebook: DataFrame) -> DataFrame:
    """queries with t: the squared distances to each part's sub-vectors."""

    def table(subs, m):
        w = F.size(F.element_at(subs, 1)["sub"])
        return F.transform(subs, lambda s: V.l2_squared(F.slice("q", m * w + 1, w), s["sub"]))

    return queries.join(F.broadcast(_book(codebook))).select(*queries.columns, F.transform("book", table).alias("t"))


def _table_distance():
    return F.aggregate(F.zip_with("t", "codes", lambda t, c: F.element_at(t, c + 1)), F.lit(0.0), lambda a, x: a + x)


def pq_search(vectors: DataFrame, coded: DataFrame, queries: DataFrame, codebook: DataFrame, k: int, wider: int = 10) -> DataFrame:
    """k * wider candidates by table distances, then exact distances of those."""
    return in_blocks(queries, lambda q: _pq_block(vectors, coded, q, codebook, k, wider))


def _pq_block(vectors: DataFrame, coded: DataFrame, queries: DataFrame, codebook: DataFrame, k: int, wider: int) -> DataFrame:
    near = top(pq_adc(coded, queries, codebook), ["qid"], "distance", "vec_id", k * wider).select("qid", "vec_id")
    exact = vectors.join(F.broadcast(near), "vec_id").join(F.broadcast(queries), "qid").select("qid", "vec_id", V.l2(F.col("embedding"), F.col("q")).alias("distance"))
    return top(exact, ["qid"], "distance", "vec_id", k).select("qid", "vec_id", "distance", "rank")


def pq_search_exact(vectors: DataFrame, queries: DataFrame, codebook: DataFrame, k: int, wider: int = 10) -> DataFrame:
    """pq_search, and then every vector that its code cannot rule out: the k nearest, proven.

    A vector lies within its error (the distance to its decoded form) of what the tables measure; it is ruled out where
    table distance less error is above the query's k-th distance so far. Distances are L2.
    """
    coded = written(pq_encode(vectors, codebook), "pq-codes")
    stored = vectors.select("vec_id", "embedding").join(coded, "vec_id").join(F.broadcast(_book(codebook)))
    decoded = F.flatten(F.transform("codes", lambda c, m: F.element_at(F.element_at(F.col("book"), m + 1), c + 1)["sub"]))
    stored = written(stored.select("vec_id", "embedding", "codes", V.l2(F.col("embedding"), decoded).alias("error")), "pq-stored")

    def block(q: DataFrame) -> DataFrame:
        first = _best(stored, q, k * wider, columns=("codes",), score=_table_matrix(_tables(q, codebook))).select("qid", "vec_id")
        exact = vectors.join(F.broadcast(first), "vec_id").join(F.broadcast(q), "qid").select("qid", "vec_id", V.l2(F.col("embedding"), F.col("q")).alias("distance"))
        limits = kth(top(exact, ["qid"], "distance", "vec_id", k), q, k)
        limit = np.array([r.limit for r in limits.orderBy("qid").select("limit").collect()])[:, None] + SLACK
        if not len(limit):
            return _knn_block(vectors, q, k, "l2")
        tables = _table_matrix(_tables(q, codebook))
        return _best(stored, q, k, columns=("codes", "error"), allowed=lambda b: np.sqrt(tables(b)) - np.asarray(b.column(3)) <= limit)

    return in_blocks(queries, block)


def _table_matrix(tables: DataFrame):
    """A function from batches (vec_id, embedding, codes) to the squared table distances of all queries of the block."""
    t = np.array([r.t for r in tables.orderBy("qid").select("t").collect()], np.float64)  # queries x parts x codes

    def run(b: pa.RecordBatch) -> np.ndarray:
        codes = np.asarray(b.column(2).flatten()).reshape(len(b), -1)
        return sum(t[:, m, codes[:, m]] for m in range(codes.shape[1]))

    return run


def kth(found: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """queries with limit: the distance of the k-th found, infinite where fewer were found."""
    far = found.where(F.col("rank") == k - 1).select("qid", F.col("distance").alias("limit"))
    return written(queries.join(far, "qid", "left").withColumn("limit", F.coalesce("limit", F.lit(float("inf")))), "search-limits")


def compression(dim: int, parts: int, codes: int) -> float:
    return dim * 4 / (parts * (1 if codes <= 256 else 2))


# graph shards ----------------------------------------------------------------------------------------------------


class Graph:
    """A navigable small-world graph over one shard (L2)."""

    def __init__(self, links: int = 16, width: int = 100, seed: int = 42):
        if not 4 <= links <= 64 or width < links:
            raise ValueError("links from 4 to 64, width at least links")
        self.m, self.width, self.rng = links, width, np.random.default_rng(seed)
        self.x: np.ndarray = np.zeros((0, 0))
        self.edges: list[list[list[int]]] = []
        self.entry = -1

    def _near(self, q: np.ndarray, start: list[int], ef: int, level: int) -> list[tuple[float, int]]:
        seen = set(start)
        first = [(float(((self.x[i] - q) ** 2).sum()), i) for i in start]
        todo, best = list(first), [(-d, i) for d, i in first]
        heapq.heapify(todo)
        heapq.heapify(best)
        while todo:
            d, i = heapq.heappop(todo)
            if d > -best[0][0] and len(best) >= ef:
                break
            new = [j for j in self.edges[i][level] if j not in seen]
            if new:
                seen.update(new)
                for e, j in zip(((self.x[new] - q) ** 2).sum(1).tolist(), new, strict=True):
                    if len(best) < ef or e < -best[0][0]:
                        heapq.heappush(todo, (e, j))
                        heapq.heappush(best, (-e, j))
                        if len(best) > ef:
                            heapq.heappop(best)
        return sorted((-d, i) for d, i in best)

    def _pick(self, found: list[tuple[float, int]], most: int) -> list[int]:
        out: list[int] = []
        for d, i in found:  # nearer to the point than to any neighbour taken so far
            if len(out) < most and (not out or ((self.x[out] - self.x[i]) ** 2).sum(1).min() > d):
                out.append(i)
        return out + [i for _, i in found if i not in out][: most - len(out)]

    def build(self, x: np.ndarray) -> "Graph":
        self.x = x
        for i in range(len(x)):
            level = int(-math.log(max(self.rng.random(), 1e-12)) / math.log(self.m))
            self.edges.append([[] for _ in range(level + 1)])
            if self.entry < 0:
                self.entry = i
                continue
            at, high = [self.entry], len(self.edges[self.entry]) - 1
            for lv in range(high, level, -1):
                at = [self._near(x[i], at, 1, lv)[0][1]]
            for lv in range(min(level, high), -1, -1):
                found = self._near(x[i], at, self.width, lv)
                most = self.m * 2 if lv == 0 else self.m
                self.edges[i][lv] = self._pick(found, self.m)
                for j in self.edges[i][lv]:
                    e = self.edges[j][lv]
                    e.append(i)
                    if len(e) > most:
                        self.edges[j][lv] = self._pick(sorted(zip(((x[e] - x[j]) ** 2).sum(1).tolist(), e, strict=True)), most)
                at = [j for _, j in found]
            if level > high:
                self.entry = i
        return self

    def frozen(self) -> tuple:
        """The graph as arrays: vectors, links end to end, their number by node and level, levels by node, entry."""
        flat = [np.array([j for x in self.edges for e in x for j in e], np.int32), np.array([len(e) for x in self.edges for e in x], np.int32)]
        return (self.x.astype(np.float32), *flat, np.array([len(x) for x in self.edges], np.int16), self.entry)

    @classmethod
    def thawed(cls, frozen: tuple) -> "Graph":
        x, flat, sizes, levels, entry = frozen
        g = cls()
        g.x, g.entry = x.astype(np.float64), entry
        cut = np.split(flat, np.cumsum(sizes)[:-1]) if len(sizes) else []
        at = 0
        for n in levels.tolist():
            g.edges.append([e.tolist() for e in cut[at : at + n]])
            at += n
        return g

    def search(self, q: np.ndarray, k: int, ef: int) -> list[tuple[float, int]]:
        if self.entry < 0:
            return []
        at = [self.entry]
        for lv in range(len(self.edges[self.entry]) - 1, 0, -1):
            at = [self._near(q, at, 1, lv)[0][1]]
        return [(math.sqrt(d), i) for d, i in self._near(q, at, max(ef, k), 0)[:k]]


def hnsw_build(vectors: DataFrame, metric: str = "l2", links: int = 16, width: int = 100, shards: int | None = None, seed: int = 42) -> DataFrame:
    """shard, graph, metric: graphs over shards of ids (4 at least, about SHARD_ROWS each), built once and written.

    Graphs compare by L2. For cosine, vectors are normalised; for the inner product, each gets one more coordinate that
    makes all lengths equal, so that the nearest by L2 has the greatest product.
    """
    n = shards or max(4, vectors.count() // SHARD_ROWS + 1)
    far = float(vectors.agg(F.max(V.dot(F.col("embedding"), F.col("embedding")))).first()[0] or 0.0) if metric == "inner_product" else 0.0

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("vec_id")
        x = spread(np.array(part["embedding"].tolist(), np.float64), metric, far)
        blob = pickle.dumps((part["vec_id"].tolist(), Graph(links, width, seed).build(x).frozen()))
        return pd.DataFrame([(int(part["s"].iloc[0]), blob, metric)], columns=["shard", "graph", "metric"])

    ship(vectors.sparkSession)
    dealt = vectors.select("vec_id", "embedding", F.pmod(F.xxhash64("vec_id"), F.lit(n)).alias("s")).groupBy("s")
    return written(dealt.applyInPandas(lambda p: run(p), "shard long, graph binary, metric string"), "graphs")


def spread(x: np.ndarray, metric: str, far: float | None = None) -> np.ndarray:
    """Vectors in the space that a graph of this metric compares by L2; far: the greatest squared length, None for queries."""
    if metric == "l2" or not len(x):
        return x
    if metric == "cosine":
        n = np.linalg.norm(x, axis=1, keepdims=True)
        return np.divide(x, n, out=x.copy(), where=n > 0)
    last = np.zeros(len(x)) if far is None else np.sqrt(np.maximum(far - (x**2).sum(1), 0))
    return np.c_[x, last]


def hnsw_query(index: DataFrame, vectors: DataFrame, queries: DataFrame, k: int, metric: str = "l2", ef: int = 100) -> DataFrame:
    """The nearest k by a built index: k rows from each graph, their true distances, the best of all."""
    return in_blocks(queries, lambda q: _graph_block(index, vectors, q, k, metric, ef))


def _graph_block(index: DataFrame, vectors: DataFrame, queries: DataFrame, k: int, metric: str, ef: int) -> DataFrame:
    q = queries.orderBy("qid").toPandas()  # one block
    qid, qm = q["qid"].tolist(), spread(np.array(q["q"].tolist(), np.float64), metric)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for blob in b["graph"]:
                ids, frozen = pickle.loads(blob)
                g = Graph.thawed(frozen)
                yield pd.DataFrame([(i, ids[j]) for i, v in zip(qid, qm, strict=True) for _, j in g.search(v, k, ef)], columns=["qid", "vec_id"])

    ship(index.sparkSession)
    near = index.select("graph").repartition(max(1, min(256, index.sparkSession.sparkContext.defaultParallelism))).mapInPandas(run, "qid long, vec_id long")
    exact = vectors.select("vec_id", "embedding").join(near, "vec_id").join(F.broadcast(queries.select("qid", "q")), "qid")
    return top(exact.select("qid", "vec_id", V.METRICS[metric](F.col("embedding"), F.col("q")).alias("distance")), ["qid"], "distance", "vec_id", k).select("qid", "vec_id", "distance", "rank")


def hnsw_levels(index: DataFrame) -> DataFrame:
    """shard, level, nodes, links: nodes that reach each level of each graph, and their links there."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for shard, blob in zip(b["shard"], b["graph"], strict=True):
                edges = Graph.thawed(pickle.loads(blob)[1]).edges
                n = [(len(e), lv) for x in edges for lv, e in enumerate(x)]
                yield pd.DataFrame([(shard, lv, sum(m == lv for _, m in n), sum(c for c, m in n if m == lv)) for lv in sorted({m for _, m in n})], columns=["shard", "level", "nodes", "links"])

    ship(index.sparkSession)
    return index.select("shard", "graph").mapInPandas(run, "shard long, level int, nodes long, links long")


def ivf_pq_search(assigned: DataFrame, coded: DataFrame, queries: DataFrame, centroids: DataFrame, codebook: DataFrame, k: int, probes: int, wider: int = 10) -> DataFrame:
    """Candidates by table distances in the probed lists alone, then exact distances of k * wider of them."""

    def block(q: DataFrame) -> DataFrame:
        probed = ivf_probe(q, centroids, probes).select("qid", "cluster_id")
        listed = assigned.select("vec_id", "cluster_id").join(coded, "vec_id").join(F.broadcast(probed), "cluster_id")
        d = listed.join(F.broadcast(_tables(q.select("qid", "q"), codebook).drop("q")), "qid")
        near = top(d.select("qid", "vec_id", _table_distance().alias("distance")), ["qid"], "distance", "vec_id", k * wider).select("qid", "vec_id")
        exact = assigned.select("vec_id", "embedding").join(near, "vec_id").join(F.broadcast(q), "qid")
        return top(exact.select("qid", "vec_id", V.l2(F.col("embedding"), F.col("q")).alias("distance")), ["qid"], "distance", "vec_id", k).select("qid", "vec_id", "distance", "rank")

    return in_blocks(queries, block)


def hnsw_search(vectors: DataFrame, queries: DataFrame, k: int, links: int = 16, width: int = 100, ef: int = 100, shards: int | None = None, seed: int = 42) -> DataFrame:
    """Graphs built once (L2), and searched for all blocks of queries."""
    return hnsw_query(hnsw_build(vectors, "l2", links, width, shards, seed), vectors, queries, k, "l2", ef)
