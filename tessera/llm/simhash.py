"""SimHash near-duplicates: fingerprints, a trie self-join within a Hamming budget, and link classes.

Two fingerprints that differ in at most 2 bits agree in at least 2 of 4 blocks of 16 bits. Each of the 6 block pairs
deals the distinct fingerprints into groups; a group's binary trie over the other 32 bits is joined with itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import connected
from tessera.session import ship, shuffle_partitions, written

SEED = 42
BUDGET = 2
PAIRS = tuple(combinations(range(4), 2))
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str | None, width: int = 3) -> int:
    """64-bit SimHash of width-word shingles; no words: 0; fewer words than width: one shingle of all."""
    if not text:
        return 0
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()  # bytes split at \x20 and \x09-\x0d alone
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if len(words) < width:
        return h(b" ".join(words), SEED)
    if width == 3:
        got = [h(b"%b %b %b" % x, SEED) for x in zip(words, words[1:], words[2:])]
    else:
        got = [h(b" ".join(words[i : i + width]), SEED) for i in range(len(words) - width + 1)]
    a = np.array(got, dtype=np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(a), 1 << 16):
        ones += np.unpackbits(a[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(a), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """key, fp (the 64 bits as a signed long). Null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, width) for t in b.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=[key, "fp"])

    ship(docs.sparkSession)
    d = docs.select(F.col(key), F.col(text))
    return d.mapInArrow(run, f"`{key}` {d.schema[0].dataType.simpleString()}, fp long")


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


def trie_join(keys: np.ndarray, rest: np.ndarray, bits: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of equal keys whose rest differ in at most budget bits; (keys, rest) sorted, rest distinct in a key.

    Level by level, node pairs (ranges of the sorted array) are split at the next bit; a pair of unlike children costs
    one bit, and a pair above the budget goes. Pairs of single leaves are settled at once.
    """
    edge = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    stop = np.r_[edge[1:], len(keys)]
    many = stop - edge > 1
    a0, a1 = edge[many], stop[many]
    b0, b1, cost = a0.copy(), a1.copy(), np.zeros(len(a0), np.int64)
    left, right = [], []
    for depth in range(bits - 1, -1, -1):
        single = (a1 - a0 == 1) & (b1 - b0 == 1)
        if single.any():
            i, j = a0[single], b0[single]
            ok = (i != j) & (_popcount(rest[i] ^ rest[j]) <= budget)
            left.append(i[ok])
            right.append(j[ok])
            a0, a1, b0, b1, cost = (x[~single] for x in (a0, a1, b0, b1, cost))
        if not len(a0):
            break
        # middles of all nodes at this depth: first index whose bit is set (each node shares the higher bits)
        bit = (rest >> np.uint64(depth)) & np.uint64(1)
        zeros = np.r_[0, np.cumsum(bit == 0)]
        am, bm = a0 + zeros[a1] - zeros[a0], b0 + zeros[b1] - zeros[b0]
        same = (a0 == b0) & (a1 == b1)
        kids = [(a0, am, b0, bm, cost, None), (am, a1, bm, b1, cost, None), (a0, am, bm, b1, cost + 1, None), (am, a1, b0, bm, cost + 1, same)]
        out = []
        for p0, p1, q0, q1, c, drop in kids:
            ok = (p1 > p0) & (q1 > q0) & (c <= budget) & ~((p0 == q0) & (p1 - p0 == 1) & (q1 - q0 == 1))
            if drop is not None:
                ok &= ~drop
            out.append([x[ok] for x in (p0, p1, q0, q1, c)])
        a0, a1, b0, b1, cost = (np.concatenate(x) for x in zip(*out, strict=True))
    if len(a0):  # all bits read: what is left differs within the budget
        ok = a0 != b0
        left.append(a0[ok])
        right.append(b0[ok])
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def links(distinct: DataFrame, budget: int = BUDGET) -> DataFrame:
    """a, b (signed longs, a < b as unsigned ranks in a bucket) of all distinct fingerprints within the budget (2 at most)."""
    if not 0 <= budget <= 2:
        raise ValueError("blocks of 4 prove budgets of 0 to 2 alone")
    n = shuffle_partitions(distinct.sparkSession) * 4

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.asarray(b.column(0)).view(np.uint64)
            for k, (i, j) in enumerate(PAIRS):
                key = ((fp >> np.uint64(16 * i)) & np.uint64(0xFFFF)) << np.uint64(16) | (fp >> np.uint64(16 * j)) & np.uint64(0xFFFF)
                spot = (key + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
                yield pa.RecordBatch.from_arrays([pa.array((spot % np.uint64(n)).astype(np.int32)), pa.array(np.full(len(fp), k, np.int32)), pa.array(fp.view(np.int64))], names=["bucket", "pair", "fp"])

    def join(t: pa.Table) -> pa.Table:
        fp, pair = np.asarray(t.column("fp").combine_chunks()).view(np.uint64), np.asarray(t.column("pair").combine_chunks())
        lo, hi = [], []
        m = np.uint64(0xFFFF)
        for k, (i, j) in enumerate(PAIRS):
            f = fp[pair == k]
            block = [(f >> np.uint64(16 * x)) & m for x in range(4)]
            u, v = (x for x in range(4) if x not in (i, j))
            key, rest = block[i] << np.uint64(16) | block[j], block[u] << np.uint64(16) | block[v]
            order = np.lexsort((rest, key))
            key, rest, f = key[order], rest[order], f[order]
            a, b = trie_join(key, rest, 32, budget)
            x, y = f[a], f[b]
            # a link is told by its first pair of equal blocks alone
            d = x ^ y
            equal = [(d >> np.uint64(16 * z)) & m == 0 for z in range(4)]
            first = np.ones(len(d), bool)
            for i2, j2 in PAIRS[:k]:
                first &= ~(equal[i2] & equal[j2])
            lo.append(np.minimum(x, y)[first])
            hi.append(np.maximum(x, y)[first])
        return pa.table({"a": np.concatenate(lo).view(np.int64), "b": np.concatenate(hi).view(np.int64)})

    ship(distinct.sparkSession)
    return distinct.select("fp").mapInArrow(deal, "bucket int, pair int, fp long").groupBy("bucket").applyInArrow(join, "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, budget: int = BUDGET) -> DataFrame:
    """Per row: key, fingerprint (16 lowercase hex digits), component_id (smallest key reachable over links).

    Texts without words (null, empty) share fingerprint zero and are linked like any other. Repeated rows each come
    back; a null key is passed over by the minimum, and a component of null keys alone has a null id. Empty in, empty out.
    """
    fps = written(fingerprints(docs, key, text, width), "simhash")
    classes = written(fps.groupBy("fp").agg(F.min(key).alias("least")), "simhash-classes")
    found = written(links(classes, budget), "simhash-links")
    roots = connected(found)
    of = classes.join(roots, classes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = of.groupBy("root").agg(F.min("least").alias("component_id"))
    named = of.join(ids, "root").select("fp", "component_id")
    return fps.join(named, "fp").select(key, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
