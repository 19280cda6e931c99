"""Row versions, log analysis, redo and undo over tables of versions and log records."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import written


def visible(horizon: int, active: Iterable[int], created: str = "created_by", deleted: str = "deleted_by", own: int | None = None) -> Column:
    """A version is seen if its creator had committed at the snapshot (or is the reader) and its deleter had not.

    horizon: the last transaction that had begun; active: those then still open; deleted 0 or null: live.
    """
    open_ = list(active)

    def done(c: Column) -> Column:
        was = (c <= horizon) & ~c.isin(open_) if open_ else c <= horizon
        return was if own is None else was | (c == own)

    d = F.coalesce(F.col(deleted), F.lit(0))
    return done(F.col(created)) & ((d == 0) | ~done(d))


def newest(versions: DataFrame, key: str, order: str, seen: Column) -> DataFrame:
    """The newest visible version of each key: what a statement reads that takes a new snapshot each time."""
    row = F.max_by(F.struct(*versions.columns), F.col(order)).alias("v")
    return versions.where(seen).groupBy(F.col(key).alias("__k")).agg(row).select("v.*")


def analysis(wal: DataFrame, start: int = 0) -> tuple[DataFrame, DataFrame]:
    """Transactions (txn, last_lsn, state) and dirty pages (page, rec_lsn) of wal (lsn, txn, kind, page) from a checkpoint on."""
    w = wal.where(F.col("lsn") >= start)
    state = F.when(F.max_by("kind", "lsn") == "commit", "committed").when(F.max_by("kind", "lsn") == "abort", "aborted").otherwise("active")
    txns = w.groupBy("txn").agg(F.max("lsn").alias("last_lsn"), state.alias("state"))
    pages = w.where("kind IN ('insert', 'update', 'delete')").groupBy("page").agg(F.min("lsn").alias("rec_lsn"))
    return txns, pages


def redo(wal: DataFrame, dirty: DataFrame, pages: DataFrame) -> DataFrame:
    """page, lsn, image: the last change that each page must take: not before its rec_lsn, and after its stored page_lsn.

    Changes of all transactions are repeated, as recovery does; pages that hold everything give no row.
    """
    w = wal.where("kind IN ('insert', 'update', 'delete')").join(dirty, "page").where(F.col("lsn") >= F.col("rec_lsn"))
    w = w.join(pages.select("page", "page_lsn"), "page", "left").where(F.col("page_lsn").isNull() | (F.col("lsn") > F.col("page_lsn")))
    return w.groupBy("page").agg(F.max("lsn").alias("lsn"), F.max_by("after", "lsn").alias("image"))


def undo(wal: DataFrame, txns: DataFrame) -> DataFrame:
    """Changes of transactions that neither committed nor aborted, newest first by lsn: lsn, txn, page, before."""
    losers = txns.where("state = 'active'").select("txn")
    return wal.where("kind IN ('insert', 'update', 'delete')").join(losers, "txn", "left_semi").select("lsn", "txn", "page", "before")


def checkpoint(txns: DataFrame, dirty: DataFrame) -> DataFrame:
    """One row: redo_lsn (least rec_lsn of a dirty page), active transactions, dirty pages."""
    a = txns.agg(F.sum((F.col("state") == "active").cast("long")).alias("active"))
    d = dirty.agg(F.min("rec_lsn").alias("redo_lsn"), F.count(F.lit(1)).alias("dirty"))
    return d.join(F.broadcast(a.withColumn("active", F.coalesce("active", F.lit(0).cast("long")))))  # two single rows


def stats(wal: DataFrame) -> DataFrame:
    """active, committed, aborted, mean_ms of wal (txn, lsn, kind, us): the mean is over finished transactions."""
    t = wal.groupBy("txn").agg(F.max_by("kind", "lsn").alias("last"), (F.max("us") - F.min("us")).alias("us"))
    n = lambda k: F.sum((F.col("last") == k).cast("long")).alias
    over = F.col("last").isin("commit", "abort")
    return t.agg(F.sum((~over).cast("long")).alias("active"), n("commit")("committed"), n("abort")("aborted"), F.round(F.avg(F.when(over, F.col("us") / 1000.0)), 6).alias("mean_ms"))


def distances(edges: DataFrame, sources: DataFrame, most: int = 1_000) -> DataFrame:
    """src, node, hops: breadth-first from each source (src) over edges (a, b); a frontier meets each node once.

    Every round is written, so plans stay short; rounds end when nothing new is reached.
    """
    e = written(edges.select("a", "b").distinct(), "edges")
    seen = front = written(sources.select("src", F.col("src").alias("node"), F.lit(0).alias("hops")).distinct(), "front")
    for k in range(1, most + 1):
        step = front.join(e, front["node"] == e["a"]).select("src", F.col("b").alias("node")).distinct()
        front = written(step.join(seen.select("src", "node"), ["src", "node"], "left_anti").withColumn("hops", F.lit(k)), "front")
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)
    raise RuntimeError("more rounds than allowed")


def cycles(waits: DataFrame) -> DataFrame:
    """txn: every transaction on a cycle of the wait-for graph (a waits for b)."""
    e = waits.select("a", "b").distinct()
    reach = distances(e, e.select(F.col("a").alias("src")).distinct())
    return e.join(reach, (F.col("b") == F.col("src")) & (F.col("a") == F.col("node")), "left_semi").select(F.col("a").alias("txn")).distinct()
