"""Benchmark decontamination with a positional inverted index.

The index is dealt by documents: each shard row holds the postings (term, positions) of its documents for the terms
that the test items use. A window's lists are intersected from the rarest term on, each list moved back by the term's
offset; exact phrases need every list to agree, proximity matches allow each term a slop.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import ship, written

WINDOW = 10
SHARD_BYTES = 4 << 20
#: Test items are sent to all tasks in blocks of about this many bytes of text; a worker holds one block at a time.
BLOCK_BYTES = 8 << 20
_WORDS = bytes(32 if c < 48 or 58 <= c < 65 or 91 <= c < 97 or 123 <= c < 128 else c + 32 if 65 <= c < 91 else c for c in range(256))
INDEX = "shard long, keys binary, nulls binary, sizes binary, counts array<int>, terms binary, positions binary"


def words(text: str | None) -> list[bytes]:
    """Words of a text, A-Z lower-cased: runs of ASCII letters, digits and all that is not ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()


@dataclass
class Items:
    """Distinct windows of a block of test items over term numbers, as arrays."""

    terms: dict[bytes, int]
    grid: np.ndarray  # a row a window: its terms, then -1 where the item is shorter
    edge: np.ndarray  # owner[edge[w] : edge[w + 1]]: items of window w
    owner: np.ndarray
    ids: list  # distinct item ids


def items_of(rows: list[tuple], width: int = WINDOW, terms: dict[bytes, int] | None = None) -> Items:
    """Windows of the rows (item id, text). Terms are numbered in `terms`, which may be shared by several blocks."""
    terms = {} if terms is None else terms
    ids: dict = {}
    grids, owners = [np.zeros((0, width), np.int32)], [np.zeros(0, np.int64)]
    for item, text in rows:
        t = np.array([terms.setdefault(w, len(terms)) for w in words(text)], np.int32)
        number = ids.setdefault(item, len(ids))
        if len(t):
            grids.append(np.lib.stride_tricks.sliding_window_view(np.pad(t, (0, max(0, width - len(t))), constant_values=-1), width))
            owners.append(np.full(len(grids[-1]), number))
    grid, owner = np.concatenate(grids), np.concatenate(owners)
    if not len(grid):
        return Items(terms, grid, np.zeros(1, np.int64), owner, list(ids))
    grid, window = np.unique(grid, axis=0, return_inverse=True)
    pairs = np.unique(np.stack([window.ravel(), owner], 1), axis=0)
    return Items(terms, grid, np.searchsorted(pairs[:, 0], np.arange(len(grid) + 1)), pairs[:, 1], list(ids))


def spacing(slop: int) -> int:
    """Empty positions between documents: some term of a match across them would have no position within the slop."""
    return 2 * slop + 1


def shard(texts: list[str | None], terms: dict[bytes, int], slop: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document sizes, posting counts by term, and positions by term."""
    sizes, got, get, space = [], [], terms.get, [-1] * spacing(slop)
    for t in texts:
        w = words(t)
        sizes.append(len(w))
        got += [get(x, -1) for x in w]
        got += space
    tok = np.array(got, np.int32)
    pos = np.flatnonzero(tok >= 0)
    order = np.argsort(tok[pos], kind="stable")
    return np.array(sizes, np.int64), np.bincount(tok[pos], minlength=len(terms)).astype(np.int64), pos[order].astype(np.int64)


def match(items: Items, counts: np.ndarray, positions: np.ndarray, rarity: np.ndarray, slop: int = 0) -> Iterator[tuple[int, int, np.ndarray, int]]:
    """(window, its size, start positions, offset of its rarest term) for each window that occurs: every term at its
    offset, give or take slop."""
    edge = np.r_[0, np.cumsum(counts)]
    here = np.flatnonzero(np.r_[counts > 0, True][items.grid].all(1))  # -1 takes the last, which is there
    grid = items.grid[here]
    order = np.argsort(np.r_[rarity, np.iinfo(np.int64).max][grid], axis=1, kind="stable")
    for w, ts, by in zip(here.tolist(), grid.tolist(), order.tolist(), strict=True):
        n = len(ts) - ts.count(-1)
        first = by[0]
        start = positions[edge[ts[first]] : edge[ts[first] + 1]] - first
        for i in by[1:n]:
            p = positions[edge[ts[i]] : edge[ts[i] + 1]]
            start = start[np.searchsorted(p, start + i + slop, "right") > np.searchsorted(p, start + i - slop)]
            if not len(start):
                break
        if len(start):
            yield w, n, start, first


def hits(items: Items, sizes: np.ndarray, counts: np.ndarray, positions: np.ndarray, rarity: np.ndarray, slop: int = 0) -> tuple[np.ndarray, list[list]]:
    """Mask of hit positions of a shard, and the ids of the items found in each document."""
    wide = sizes + spacing(slop)
    total = int(wide.sum())
    delta = np.zeros(total + 1, np.int32)
    begins = np.cumsum(wide) - wide
    found: list[set[int]] = [set() for _ in sizes]
    for w, n, start, first in match(items, counts, positions, rarity, slop):
        np.add.at(delta, np.maximum(start, 0), 1)
        np.add.at(delta, np.minimum(start + n, total), -1)
        for d in np.unique(np.searchsorted(begins, start + first, "right") - 1):  # the rarest term lies in the document
            found[d].update(items.owner[items.edge[w] : items.edge[w + 1]].tolist())
    return np.cumsum(delta)[:-1] > 0, [[items.ids[i] for i in sorted(f)] for f in found]


def blocks(benchmark: DataFrame, item: str, text: str, width: int, terms: dict[bytes, int]) -> Iterator[Items]:
    """The items in blocks, their terms numbered across all blocks."""
    rows, size = [], 0
    for r in benchmark.select(F.col(item), F.col(text)).toLocalIterator():
        rows.append(tuple(r))
        size += len((r[1] or "").encode("utf-8", "surrogatepass"))
        if size >= BLOCK_BYTES:
            yield items_of(rows, width, terms)
            rows, size = [], 0
    yield items_of(rows, width, terms)


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= SHARD_BYTES:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def build(docs: DataFrame, terms: dict[bytes, int], key: str = "doc_id", text: str = "text", slop: int = 0) -> DataFrame:
    """INDEX rows, a shard each, written to the shared folder: document keys and sizes, postings by term."""
    from pyspark import TaskContext

    sent = docs.sparkSession.sparkContext.broadcast(terms)  # the distinct words of the test items

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, terms = 0, sent.value
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            for i, j in _slices(texts):
                part = ids.slice(i, j - i)
                sizes, counts, positions = shard(texts[i:j], terms, slop)
                steps = np.diff(positions, prepend=0).astype(np.int32)  # small where a term is common
                used = np.flatnonzero(counts).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    pa.array([TaskContext.get().partitionId() << 32 | n]), pa.array([np.asarray(part.fill_null(0)).astype(np.int64).tobytes()]),
                    pa.array([np.packbits(np.asarray(part.is_null())).tobytes()]), pa.array([sizes.tobytes()]), pa.array([counts[used].tolist()], pa.list_(pa.int32())),
                    pa.array([used.tobytes()]), pa.array([steps.tobytes()])], names=["shard", "keys", "nulls", "sizes", "counts", "terms", "positions"])
                n += 1

    ship(docs.sparkSession)
    return written(docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(run, INDEX), "postings")


def rarity(index: DataFrame, n_terms: int) -> np.ndarray:
    """Postings of each term over the whole index (one number a term of the test items)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for b in batches:
            for used, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total[np.frombuffer(used, np.int32)] += np.array(counts, np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["term", "n"])

    out = np.zeros(n_terms, np.int64)
    for t, n in index.select("terms", "counts").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n")).collect():
        out[t] = n
    return out


OUT = "key long, n_words long, n_hit long, items array<{kind}>, begin array<int>, stop array<int>"


def _digest(keys: list, sizes: np.ndarray, mask: np.ndarray, found: list[list], slop: int, kind: str) -> pa.RecordBatch:
    begins = np.cumsum(sizes + spacing(slop)) - sizes - spacing(slop)
    n_hit, begin, stop = [], [], []
    for a, n in zip(begins.tolist(), sizes.tolist(), strict=True):
        m = mask[a : a + n]
        turn = np.flatnonzero(np.diff(np.r_[False, m, False].astype(np.int8)))
        n_hit.append(int(m.sum()))
        begin.append(turn[::2].tolist())
        stop.append(turn[1::2].tolist())
    ints = pa.list_(pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(found, pa.list_(pa.int64() if kind == "bigint" else pa.string())), pa.array(begin, ints), pa.array(stop, ints)], names=["key", "n_words", "n_hit", "items", "begin", "stop"])


def search(index: DataFrame, parts: list[Broadcast], n_terms: int, kind: str, slop: int = 0) -> DataFrame:
    """key, n_words, n_hit, items (ids), begin and stop (word spans) for each document of an index built with this slop.

    parts: blocks of items over the index's term numbers. Each shard is searched for one block after the other.
    """
    rare = rarity(index, n_terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                sizes = np.frombuffer(r["sizes"], np.int64)
                counts = np.zeros(n_terms, np.int64)
                counts[np.frombuffer(r["terms"], np.int32)] = r["counts"]
                positions = np.cumsum(np.frombuffer(r["positions"], np.int32), dtype=np.int64)
                mask, found = np.zeros(int((sizes + spacing(slop)).sum()), bool), [{} for _ in sizes]
                for sent in parts:
                    m, f = hits(sent.value, sizes, counts, positions, rare, slop)
                    mask |= m
                    for to, more in zip(found, f, strict=True):
                        to.update(dict.fromkeys(more))
                    if len(parts) > 1:
                        vars(sent).pop("_value", None)  # the next block takes its room
                null = np.unpackbits(np.frombuffer(r["nulls"], np.uint8), count=len(sizes))
                keys = [None if z else k for k, z in zip(np.frombuffer(r["keys"], np.int64).tolist(), null, strict=True)]
                yield _digest(keys, sizes, mask, [list(f) for f in found], slop, kind)

    return index.mapInArrow(run, OUT.format(kind=kind))


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", width: int = WINDOW, slop: int = 0) -> DataFrame:
    """Per document row: key (long), n_words, n_hit, items (ids whose windows occur), begin and stop (hit word spans).

    A window is width consecutive item words; a shorter item, if not empty, is one window. Null text has no words.
    slop > 0 gives proximity matches: each term may stand up to slop words off its place, in one document. Rows that
    repeat each come back; items of one id count once (item ids that are no integers come back as strings); null keys stay
    null; other columns are ignored; an empty benchmark hits nothing. Keys are integers.

    One way for every size of benchmark: its distinct words are numbered, one index of their postings is written, and all
    blocks of items are searched in that index by its global counts. The driver holds the words and one block.
    """
    ship(docs.sparkSession)
    kind = "bigint" if benchmark.schema[item].dataType.typeName() in ("byte", "short", "integer", "long") else "string"
    terms: dict[bytes, int] = {}
    send = docs.sparkSession.sparkContext.broadcast
    parts = [send(replace(x, terms={})) for x in blocks(benchmark.select(F.col(item).cast(kind).alias("i"), F.col(item_text).alias("t")), "i", "t", width, terms)]
    out = search(build(docs, terms, key, text, slop), parts, len(terms), kind, slop)
    return out.withColumnRenamed("key", key)
