"""Removal of repeated substrings by prefix-free parsing.

Triggers of a rolling hash cut each text into overlapping phrases so that every string of `width` bytes lies in
exactly one phrase and equal strings lie at the same trigger: a trigger is the least K-gram hash of a window (a local
minimum rather than a residue, which could miss windows). The parse is the list of phrases in document order.

1. Each batch (a range of doc_ids) sends its distinct (trigger, phrase) hashes to the trigger's bucket.
2. The bucket tells which phrases an earlier batch has (gone whole) and which triggers start several phrases.
3. For the latter alone, phrase bytes (the dictionary) meet in the bucket. Its suffix array, cut at `width`, puts equal
   strings side by side; the parse's order within such a run tells the earliest batch.
4. Each batch combines both with its own dictionary and parse, and gives what remains.

Texts are shuffled once; the three passes over them reuse that exchange. All that crosses the shuffle after it is
distinct in a batch, so a passage in a third of all rows costs one entry for each batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.running import running
from tessera.session import ship, written

WIDTH = 50
K = 24
BATCH_BYTES = 4 << 20
BUCKET_BYTES = 8 << 20
#: Beyond so many, batches and buckets grow, to the wide sizes at most; from there on their number grows again.
MANY_BATCHES, MANY_BUCKETS, CELLS = 200_000, 20_000, 8
WIDE_BATCH, WIDE_BUCKET = 16 << 20, 64 << 20
#: The rolling hash's base (odd) and its byte table's seed.
BASE, SEED = 0x9E3779B97F4A7C55, 20240101
WHOLE, SOME, PARTS, BITS = 0, 1, 2, 3
MSG = "bucket long, batch long, kind int, source int, data binary"
#: A batch number is an age and a piece: pieces of one age hold rows of one id, which leave each other alone.
PIECES = 20
_T = np.random.default_rng(SEED).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) < n:
        out = []
        for b in (BASE, pow(BASE, -1, 1 << 64)):
            p = np.full(max(n, 1), b, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        _POWERS[:] = out
    return _POWERS[0], _POWERS[1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@dataclass
class Parse:
    """A batch: bytes, documents, phrase occurrences [first, last] window start, and distinct phrases."""

    buf: np.ndarray
    offsets: np.ndarray
    rank: np.ndarray  # of each document's id among the batch's ids; equal ids share it
    first: np.ndarray
    last: np.ndarray
    doc: np.ndarray  # document of each occurrence
    entry: np.ndarray  # distinct phrase of each occurrence
    trigger: np.ndarray  # 32 bits of each distinct phrase's trigger, in (bucket, trigger, phrase) order
    phrase: np.ndarray
    bucket: np.ndarray
    at: np.ndarray  # an occurrence of each distinct phrase

    def blob(self, which: np.ndarray) -> bytes:
        return self.trigger[which].tobytes() + self.phrase[which].tobytes()


def _minima(h: np.ndarray, span: int) -> np.ndarray:
    size = 1
    while size * 2 <= span:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[: len(h) - (span - size)], h[span - size :]) if span > size else h


def parse(buf: np.ndarray, offsets: np.ndarray, rank: np.ndarray, buckets: int, width: int) -> Parse:
    k = min(K, max(1, width // 2))
    n = len(buf)
    empty = np.zeros(0, np.int64)
    first = last = doc = empty
    trig = phr = np.zeros(0, np.uint64)
    if n >= width:
        power, inverse = _powers(n + 1)
        q = np.zeros(n + 1, np.uint64)
        np.cumsum(_T[buf] * power[:n], out=q[1:])
        grams = (q[k:] - q[:-k]) * inverse[: n - k + 1]
        low = _minima(grams, width - k + 1)
        del grams
        starts, ends = offsets[:-1], offsets[1:] - width  # window starts of a document: starts..ends
        has = ends >= starts
        brk = np.empty(len(low), bool)
        brk[0] = True
        np.not_equal(low[1:], low[:-1], out=brk[1:])
        brk[starts[has]] = True
        after = ends[has] + 1
        brk[after[after < len(low)]] = True
        cut = np.flatnonzero(brk)
        stop = np.r_[cut[1:], len(low)] - 1
        d = np.searchsorted(offsets, cut, side="right") - 1  # the last of documents that begin here; empty ones are behind
        ok = cut <= ends[d]
        first, doc = cut[ok], d[ok]
        last = np.minimum(stop[ok], ends[doc])
        trig = _mix(low[first])
        phr = _mix((q[last + width] - q[first]) * inverse[first] + (last - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    spot = (trig % np.uint64(buckets)).astype(np.int64)
    short = (trig >> np.uint64(32)).astype(np.uint32)
    order = np.lexsort((phr, short, spot))
    s, t, p = spot[order], short[order], phr[order]
    new = np.ones(len(order), bool)
    new[1:] = (s[1:] != s[:-1]) | (t[1:] != t[:-1]) | (p[1:] != p[:-1])
    entry = np.empty(len(order), np.int64)
    entry[order] = np.cumsum(new) - 1
    return Parse(buf, offsets, rank, first, last, doc, entry, t[new], p[new], s[new], order[new])


def suffix_groups(data: np.ndarray, starts: np.ndarray, age: np.ndarray, width: int) -> np.ndarray:
    """For each start, the least age among starts of the same `width` bytes.

    The suffix array of data at these starts, compared over width bytes, puts equal strings in runs.
    """
    if not len(starts):
        return age
    rows = np.lib.stride_tricks.sliding_window_view(data, width)[starts]
    order = np.argsort(np.ascontiguousarray(rows).view(f"S{width}").ravel(), kind="stable")
    same = rows[order]
    new = np.ones(len(order), bool)
    new[1:] = (same[1:] != same[:-1]).any(1)
    least = np.minimum.reduceat(age[order], np.flatnonzero(new))
    out = np.empty_like(age)
    out[order] = least[np.cumsum(new) - 1]
    return out


def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[i], first[i]+1, ... count[i] of them, for each i."""
    total = int(count.sum())
    return np.repeat(first - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(total) if total else np.zeros(0, np.int64)


def _message(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [()] * 5
    return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["bucket", "batch", "kind", "source", "data"])


def _load(t: pa.Table, buckets: int, width: int) -> tuple[Parse, pa.Array]:
    key = t.column("key").combine_chunks()
    order = np.asarray(pc.sort_indices(pa.table({"k": key}), sort_keys=[("k", "ascending")], null_placement="at_start"))
    t = t.take(pa.array(order))
    key, data = t.column("key").combine_chunks(), t.column("data").combine_chunks().cast(pa.large_binary())
    offsets = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
    whole = np.frombuffer(data.buffers()[2] or b"", np.uint8)
    buf, offsets = whole[offsets[0] : offsets[-1]], offsets - offsets[0]
    null = np.asarray(key.is_null())
    v = np.asarray(key.fill_null(0))
    rank = np.cumsum(np.r_[False, (v[1:] != v[:-1]) | (null[1:] != null[:-1])])
    return parse(buf, offsets, rank, buckets, width), key


def _flags(p: Parse, fb: pa.Table) -> tuple[np.ndarray, dict[int, list[bytes]]]:
    """Flag of each distinct phrase (-1 none), and messages of window bits by bucket."""
    flag, bits = np.full(len(p.phrase), -1, np.int8), {}
    if fb.num_rows:
        begin = lambda b: np.searchsorted(p.bucket, b)
        for _, _, kind, source, data in zip(*(fb.column(c).to_pylist() for c in ("bucket", "batch", "kind", "source", "data")), strict=True):
            if kind == BITS:
                bits[source] = data
            else:
                flag[begin(source) + np.frombuffer(data, np.uint32)] = kind
    return flag, bits


def _first_round(buckets: int, width: int):
    def run(t: pa.Table) -> pa.Table:
        p, _ = _load(t, buckets, width)
        batch = t.column("batch")[0].as_py()
        edges = np.flatnonzero(np.r_[True, p.bucket[1:] != p.bucket[:-1]]) if len(p.bucket) else []
        stops = [*edges[1:], len(p.bucket)]
        return _message([(int(p.bucket[a]), batch, PARTS, int(p.bucket[a]), p.blob(slice(a, b))) for a, b in zip(edges, stops, strict=len(edges) > 0)])

    return run


def _meet(t: pa.Table) -> pa.Table:
    """Phrases of one bucket from all batches: which are whole in an earlier batch, which triggers have several phrases."""
    batch = np.asarray(t.column("batch").combine_chunks())
    blobs = t.column("data").to_pylist()
    source = t.column("source")[0].as_py()
    order = np.argsort(batch, kind="stable")
    sizes = np.array([len(blobs[i]) // 12 for i in order])
    trig = np.concatenate([np.frombuffer(blobs[i], np.uint32, n) for i, n in zip(order, sizes, strict=True)])
    phr = np.concatenate([np.frombuffer(blobs[i], np.uint64, n, 4 * n) for i, n in zip(order, sizes, strict=True)])
    ages = batch[order] >> PIECES
    owner = np.repeat(np.arange(len(order)), sizes)
    index = _spread(np.zeros(len(order), np.int64), sizes)
    o = np.lexsort((owner, phr, trig))
    tr, ph, ow, ix = trig[o], phr[o], owner[o], index[o]
    new_t = np.r_[True, tr[1:] != tr[:-1]]
    new_p = new_t | np.r_[True, ph[1:] != ph[:-1]]
    many = np.add.reduceat(new_p.astype(np.int64), np.flatnonzero(new_t))[np.cumsum(new_t) - 1] > 1
    age = ages[ow]
    spread = np.maximum.reduceat(age, np.flatnonzero(new_t)) > np.minimum.reduceat(age, np.flatnonzero(new_t))
    many &= spread[np.cumsum(new_t) - 1]  # in one batch alone: its own affair
    out = []
    older = age > np.minimum.reduceat(age, np.flatnonzero(new_p))[np.cumsum(new_p) - 1] if len(age) else new_p
    for kind, pick in ((WHOLE, older), (SOME, ~older & many)):
        who, what = ow[pick], ix[pick].astype(np.uint32)
        by = np.lexsort((what, who))
        who, what = who[by], what[by]
        edges = np.flatnonzero(np.r_[True, who[1:] != who[:-1]]) if len(who) else []
        for a, b in zip(edges, [*edges[1:], len(who)], strict=len(edges) > 0):
            n = int(batch[order[who[a]]])
            out.append((-1 - n, n, kind, source, what[a:b].tobytes()))
    return _message(out)


def _second_round(buckets: int, width: int):
    """Sends the bytes of phrases that share a trigger with others; passes on what the batch has been told."""

    def run(t: pa.Table, fb: pa.Table) -> pa.Table:
        if not t.num_rows:
            return _message([])
        p, _ = _load(t, buckets, width)
        flag, _ = _flags(p, fb)
        batch = t.column("batch")[0].as_py()
        rows = list(zip(*(fb.column(c).to_pylist() for c in ("bucket", "batch", "kind", "source", "data")), strict=True))
        some = np.flatnonzero(flag == SOME)
        for b in np.unique(p.bucket[some]):
            own = p.at[some[p.bucket[some] == b]]
            size = p.last[own] - p.first[own] + width
            rows.append((int(b), batch, PARTS, int(b), np.uint32(len(own)).tobytes() + size.astype(np.uint32).tobytes() + p.buf[_spread(p.first[own], size)].tobytes()))
        return _message(rows)

    return run


def _order(width: int):
    """The dictionary of one bucket: window bits of what an earlier batch holds, by batch."""

    def run(t: pa.Table) -> pa.Table:
        if t.column("bucket")[0].as_py() < 0:
            return t.select(["bucket", "batch", "kind", "source", "data"])
        sizes, texts, ages, counts = [], [], [], []
        batches = t.column("batch").to_pylist()
        for batch, data in zip(batches, t.column("data").to_pylist(), strict=True):
            n = int(np.frombuffer(data, np.uint32, 1)[0])
            size = np.frombuffer(data, np.uint32, n, 4).astype(np.int64)
            sizes.append(size)
            texts.append(np.frombuffer(data, np.uint8, -1, 4 + 4 * n))
            counts.append(int((size - width + 1).sum()))
            ages.append(np.full(counts[-1], batch >> PIECES, np.int64))
        size, age = np.concatenate(sizes), np.concatenate(ages)
        starts = _spread(np.r_[0, np.cumsum(size)[:-1]], size - width + 1)
        gone = suffix_groups(np.concatenate(texts), starts, age, width) < age
        out, at, source = [], 0, t.column("source")[0].as_py()
        for batch, n in zip(batches, counts, strict=True):
            if gone[at : at + n].any():
                out.append((-1 - batch, batch, BITS, source, np.packbits(gone[at : at + n]).tobytes()))
            at += n
        return _message(out)

    return run


def _removed(p: Parse, flag: np.ndarray, bits: dict[int, bytes], width: int) -> np.ndarray:
    """Mask of the batch's removed bytes."""
    n_of = p.last - p.first + 1
    least = np.full(len(p.phrase), np.iinfo(np.int64).max)
    rank = p.rank[p.doc] if len(p.doc) else np.zeros(0, np.int64)
    np.minimum.at(least, p.entry, rank)
    whole = (flag[p.entry] == WHOLE) | (rank > least[p.entry])
    begin, length = [p.first[whole]], [n_of[whole]]

    def mark(entries: np.ndarray, value: np.ndarray, test) -> None:
        """value: by window of these entries, in their order; test(value, rank): what goes."""
        sizes = n_of[p.at[entries]]
        place = np.full(len(p.phrase), -1)
        place[entries] = np.r_[0, np.cumsum(sizes)[:-1]] if len(entries) else entries
        occ = np.flatnonzero((place[p.entry] >= 0) & ~whole)
        flat = _spread(place[p.entry[occ]], n_of[occ])
        where = _spread(p.first[occ], n_of[occ])
        gone = test(value[flat], np.repeat(rank[occ], n_of[occ]))
        begin.append(where[gone])
        length.append(np.ones(int(gone.sum()), np.int64))

    some = np.flatnonzero(flag == SOME)
    if bits:
        value = []
        for b in np.unique(p.bucket[some]):
            n = int(n_of[p.at[some[p.bucket[some] == b]]].sum())
            value.append(np.unpackbits(np.frombuffer(bits[int(b)], np.uint8), count=n).astype(bool) if int(b) in bits else np.zeros(n, bool))
        mark(some, np.concatenate(value), lambda v, r: v)
    # the batch's own dictionary: triggers with several phrases, in more than one document
    if len(p.phrase):
        new = np.r_[True, (p.trigger[1:] != p.trigger[:-1]) | (p.bucket[1:] != p.bucket[:-1])]
        group, edge = np.cumsum(new) - 1, np.flatnonzero(new)
        live = np.flatnonzero(~whole)
        hi, lo = np.full(len(edge), -1), np.full(len(edge), np.iinfo(np.int64).max)
        np.maximum.at(hi, group[p.entry[live]], rank[live])
        np.minimum.at(lo, group[p.entry[live]], rank[live])
        shared = np.flatnonzero(((np.diff(np.r_[edge, len(new)]) > 1) & (hi > lo))[group] & (flag != WHOLE))
        if len(shared):
            own = p.at[shared]
            age = np.repeat(least[shared], n_of[own])
            mark(shared, suffix_groups(p.buf, _spread(p.first[own], n_of[own]), age, width), lambda v, r: v < r)
    begin, length = np.concatenate(begin), np.concatenate(length)
    n = len(p.buf)
    edges = np.bincount(begin, minlength=n + 1)[: n + 1] - np.bincount(begin + length - 1 + width, minlength=n + 1)[: n + 1]
    return np.cumsum(edges)[:n] > 0


def _third_round(buckets: int, width: int):
    def run(t: pa.Table, fb: pa.Table) -> pa.Table:
        out = {"n_bytes": [], "kept": [], "begin": [], "stop": []}
        key = pa.array([], pa.int64())
        if t.num_rows:
            p, key = _load(t, buckets, width)
            gone = _removed(p, *_flags(p, fb), width)
            for a, b in zip(p.offsets[:-1].tolist(), p.offsets[1:].tolist(), strict=True):
                g = gone[a:b]
                turn = np.flatnonzero(np.diff(np.r_[False, g, False].astype(np.int8)))
                out["n_bytes"].append(b - a)
                out["kept"].append((p.buf[a:b][~g] if len(turn) else p.buf[a:b]).tobytes())
                out["begin"].append(turn[::2])
                out["stop"].append(turn[1::2])
        lists = pa.list_(pa.int64())
        return pa.table([key.cast(pa.int64()), pa.array(out["n_bytes"], pa.int64()), pa.array(out["kept"], pa.binary()), pa.array(out["begin"], lists), pa.array(out["stop"], lists)], names=["key", "n_bytes", "kept", "begin", "stop"])

    return run


def _batched(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, int, int]:
    """key, data, batch: ranges of keys with about as many bytes each, from exact byte counts of equal key cells.

    Cells are told in doubles, which keep the order of any longs. A cell with more than two batches' bytes (ids that crowd,
    or one id with many rows) is cut by running byte counts of its ids, and an id that alone has so much is dealt over
    pieces of one age, by a hash of the text.
    """
    d = docs.select(F.col(key).cast("long").alias("key"), F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("data"))
    size = F.octet_length("data").cast("long")
    low, high, total = d.agg(F.min("key"), F.max("key"), F.sum(size)).first()
    total = total or 0
    count = lambda size, many, wide: int(max(min(many, total // size), total // wide) + 1)
    batches, buckets = count(BATCH_BYTES, MANY_BATCHES, WIDE_BATCH), count(BUCKET_BYTES, MANY_BUCKETS, WIDE_BUCKET)
    target = max(total / batches, min(BATCH_BYTES, total), 1)
    span = 0.0 if low is None else float(high) - float(low) + 1
    cells = int(min(span, max(batches, min(batches, MANY_BATCHES) * CELLS))) if span else 0
    step = span / max(cells, 1)
    # cell 0: null keys
    at = F.floor((F.col("key").cast("double") - F.lit(float(low or 0))) / F.lit(step or 1.0)).cast("int")
    cell: Column = F.when(F.col("key").isNull(), 0).otherwise(F.least(at, F.lit(max(cells - 1, 0))) + 1)
    got = d.groupBy(cell.alias("c")).agg(F.sum(size).alias("n")).toArrow()  # at most `cells` + 1 rows
    weight = np.zeros(cells + 1)
    weight[np.asarray(got.column("c").combine_chunks())] = np.asarray(got.column("n").combine_chunks())
    heavy = np.flatnonzero(weight > 2 * target)
    light = weight.copy()
    light[heavy] = 0
    bin_ = np.floor((np.cumsum(light) - light) / target).astype(np.int64)
    # ages rise by cell; a heavy cell has its own, as many as its ids need
    turn = np.zeros(cells + 1, np.int64)
    turn[1:] = (bin_[1:] != bin_[:-1]).astype(np.int64)
    turn[heavy] = 1
    turn[heavy[heavy < cells] + 1] = 1
    if not len(heavy):
        plan = F.split(F.lit(",".join(map(str, np.cumsum(turn).tolist()))), ",").cast("array<bigint>")
        return d.withColumn("batch", F.shiftleft(F.get(plan, cell), PIECES)), batches, buckets
    crowd = d.withColumn("c", cell).where(F.col("c").isin(heavy.tolist()))
    ids = crowd.groupBy("c", "key").agg(F.sum(size).alias("n"))
    run = running(ids, ["c"], ["key"], F.col("n"), "sum", "upto")
    # an id takes the batch in which its bytes begin; one that is a batch by itself ends its age
    sub = F.floor((F.col("upto") - F.col("n")) / F.lit(target)).cast("long")
    fine = written(run.select("c", "key", sub.alias("sub"), F.least(F.ceil(F.col("n") / F.lit(target)), F.lit((1 << PIECES) - 1)).cast("long").alias("pieces")), "crowded-ids")
    most = {r["c"]: r["m"] + 1 for r in fine.groupBy("c").agg(F.max("sub").alias("m")).collect()}  # a row a heavy cell
    turn[heavy[heavy < cells] + 1] += np.array([most[c] for c in heavy[heavy < cells].tolist()], np.int64)
    plan = F.split(F.lit(",".join(map(str, np.cumsum(turn).tolist()))), ",").cast("array<bigint>")
    f = fine.select(F.col("key").alias("k"), "c", "sub", "pieces")
    both = d.withColumn("c0", cell).join(f, (F.col("c0") == F.col("c")) & F.col("key").eqNullSafe(F.col("k")), "left")
    # a key in pieces must not share its age: ids whose bytes begin with it in one sub-batch are told apart by `alone`
    piece = F.when(F.col("pieces") > 2, F.pmod(F.xxhash64("data"), F.col("pieces"))).otherwise(F.lit(0))
    age = (F.get(plan, F.col("c0")) + F.coalesce("sub", F.lit(0))) * 2 + F.when(F.col("pieces") > 2, 1).otherwise(0)
    return both.select("key", "data", (F.shiftleft(age, PIECES) + piece).alias("batch")), batches, buckets


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """Per row: key (long), n_bytes, kept (the bytes left), begin and stop (byte spans removed, maximal, in order).

    A byte goes if a string of width bytes over it also starts in a row with a smaller key; overlaps count and all
    is judged on the input. Null text is empty; a null key counts as smaller than any other; rows with equal keys
    leave each other alone; texts under width bytes stay whole. Other columns are ignored. Empty in, empty out.
    """
    ship(docs.sparkSession)
    d, _, buckets = _batched(docs, key, text)
    by = lambda: d.groupBy("batch")
    found = by().applyInArrow(_first_round(buckets, width), MSG)
    told = found.groupBy("bucket").applyInArrow(_meet, MSG)
    parts = by().cogroup(told.groupBy("batch")).applyInArrow(_second_round(buckets, width), MSG)
    bits = parts.groupBy("bucket").applyInArrow(_order(width), MSG)
    out = by().cogroup(bits.groupBy("batch")).applyInArrow(_third_round(buckets, width), "key long, n_bytes long, kept binary, begin array<long>, stop array<long>")
    return out.withColumnRenamed("key", key)
