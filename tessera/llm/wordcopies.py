"""Near copies by words: pairs whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Prefix filter, so no pair is missed: in any one order of all shingles, two such sets of n shingles share one of their
first n - ceil(0.8 n) + 1. Rare shingles come first; the order is fitted on a sample and only steers the cost. Pairs are held
against each other by marks of a bit a shingle or two before their texts are read; a mark rules out no near copy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.simhash import SEED, _LOWER
from tessera.session import ship, small_side, unwritten, written

WIDTH = 5
#: Documents whose shingles are counted for the order (one in SHARE, or SAMPLE where that is more), and most shingles it ranks.
#: The share is fixed, so that shingles of more than some 3 * SHARE documents are ranked in tables of any size; with a fixed
#: number, groups of unranked shingles would grow with the table, and pairs with their square.
SHARE, SAMPLE, RANKED = 10, 20_000, 2_000_000
#: Rounds against the first document of each shingle; what is left then is compared pair by pair.
ROUNDS = 3
#: Up to so many ids are sent to all tasks; beyond, texts are joined by shuffle.
SENT = 500_000


def shingles(text: str | None) -> np.ndarray:
    """Distinct hashes, ascending; no words: none; fewer than five words: one shingle of all."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    h = xxhash.xxh64_intdigest
    return np.unique(np.array([h(b" ".join(words[i : i + WIDTH]), SEED) for i in range(max(1, len(words) - WIDTH + 1))] if words else [], np.uint64))


def mark(s: np.ndarray) -> bytes:
    """One bit a shingle or two (at least 64, a power of two): set where an odd number of shingles fall."""
    bits = max(64, 1 << max(len(s) - 1, 0).bit_length())
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def least_difference(x: bytes, y: bytes) -> int:
    """Shingles, at the least, that only one of two marked sets has; the longer mark is folded onto the shorter."""
    if len(x) < len(y):
        x, y = y, x
    number = lambda b: int.from_bytes(b, "little")
    a = number(x)
    for size in range(len(x).bit_length() - 2, len(y).bit_length() - 2, -1):
        half = 8 << size
        a = (a >> half) ^ (a & ((1 << half) - 1))
    return (a ^ number(y)).bit_count()


def _common(docs: DataFrame, key: str, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of three or more sampled documents, ascending, and their ranks (the rarest 1)."""
    n = docs.count()
    some = docs.where(F.pmod(F.xxhash64(key), F.lit(1_000_003)) * n < 1_000_003 * max(SAMPLE, n // SHARE)).select(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t).view(np.int64))], names=["token"])

    got = some.mapInArrow(run, "token long").groupBy("token").count().where("count > 2").orderBy(F.desc("count"), "token").limit(RANKED).toArrow()
    token = np.asarray(got.column("token").combine_chunks()).view(np.uint64) if len(got) else np.zeros(0, np.uint64)
    by = np.argsort(token)
    return token[by], (len(token) - by).astype(np.int32)


def _prefixes(docs: DataFrame, key: str, text: str) -> DataFrame:
    """token, id, n, pos: of each document the shingles that one of its near copies must share; and a row with its mark."""
    tokens, ranks = _common(docs, key, text)
    sc = docs.sparkSession.sparkContext
    common = sc.broadcast((tokens, ranks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, ranks = common.value
        for b in batches:
            out, marks = [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = shingles(t)
                n = len(s)
                if not n:
                    continue
                rank = np.zeros(n, np.int32)
                if len(tokens):
                    at = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
                    rank = np.where(tokens[at] == s, ranks[at], 0)
                p = n - -(-4 * n // 5) + 1
                out.append((s[np.argsort(rank, kind="stable")[:p]], np.full(p, i, np.int64), np.full(p, n, np.int32), np.arange(p, dtype=np.int32)))
                marks.append((i, n, mark(s)))
            if out:
                token, ids, n, pos = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(ids), pa.array(n), pa.array(pos), pa.nulls(len(ids), pa.binary())], names=names)
                ids, n, m = zip(*marks, strict=True)
                yield pa.RecordBatch.from_arrays([pa.nulls(len(ids), pa.int64()), pa.array(ids, pa.int64()), pa.array(n, pa.int32()), pa.nulls(len(ids), pa.int32()), pa.array(m, pa.binary())], names=names)

    names = ["token", "id", "n", "pos", "mark"]
    return docs.select(key, text).mapInArrow(run, "token long, id long, n int, pos int, mark binary")


def _candidates(left: DataFrame, right: DataFrame) -> DataFrame:
    """a < b of one shingle whose lengths and places in the order leave room for 0.8."""
    x = left.select("token", F.col("id").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"))
    y = right.select("token", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"))
    room = "a < b AND 5 * least(na, nb) >= 4 * greatest(na, nb) AND 9 * least(na - pa, nb - pb) >= 4 * (na + nb)"
    return x.join(y, "token").where(room).select("a", "b").distinct()


def _alike(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """Pairs that their marks do not rule out: near copies of na and nb shingles differ in (na + nb) / 9 at most."""
    both = pairs.join(marks.toDF("a", "na", "ma"), "a").join(marks.toDF("b", "nb", "mb"), "b").select("a", "b", "na", "nb", "ma", "mb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            na, nb, ma, mb = (c.to_pylist() for c in t.columns[2:])
            ok = [9 * least_difference(x, y) <= n + m for n, m, x, y in zip(na, nb, ma, mb, strict=True)]
            yield t.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def _near(pairs: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """b of the pairs that are near copies, by their full sets."""
    ids = written(pairs.select(F.col("a").alias(key)).union(pairs.select("b")).distinct(), "copies-ids")
    texts = written(docs.select(key, text).join(small_side(ids, SENT), key, "left_semi"), "copies-texts")
    both = pairs.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, x = None, np.zeros(0, np.uint64)
        for batch in batches:
            keep = []
            for b, ta, tb in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if ta != last:
                    last, x = ta, shingles(ta)
                y = shingles(tb)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 5 * both >= 4 * (len(x) + len(y) - both):
                    keep.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(keep, pa.int64())], names=["id"])

    out = written(both.select("b", "ta", "tb").mapInArrow(run, "id long").distinct(), "copies-near")
    unwritten(texts)
    return out


def superfluous(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id: documents to drop, so that no two of the rest are near copies; the key is a long.

    Each is a near copy of one with a smaller key, which stays or is itself dropped so. Null keys are passed over.
    A shingle's documents are held against its first one, for ROUNDS rounds; each round drops copies and takes the first
    one out. So large groups of copies cost their size, and only the documents left are paired.
    """
    ship(docs.sparkSession)
    docs = docs.where(F.col(key).isNotNull())
    every = written(_prefixes(docs, key, text), "copies-prefixes")
    marks = written(every.where("mark IS NOT NULL").select("id", "n", "mark"), "copies-marks")
    index = every.where("mark IS NULL").select("token", "id", "n", "pos")
    shared = index.groupBy("token").count().where("count > 1").select("token")
    index, gone = written(index.join(shared, "token"), "copies-index"), None
    unwritten(every)
    for k in range(ROUNDS + 1):
        first = index.groupBy("token").agg(F.min(F.struct("id", "n", "pos")).alias("f")).select("token", "f.*")
        pairs = written(_alike(_candidates(first if k < ROUNDS else index, index), marks), "copies-pairs")
        near = _near(pairs, docs, key, text)
        gone = near if gone is None else gone.union(near)
        if k < ROUNDS:
            rest = index.join(near, "id", "left_anti").join(first.select("token", F.col("id").alias("f")), "token").where("id > f")
            index = written(rest.select("token", "id", "n", "pos"), "copies-index")
    return gone.distinct()
