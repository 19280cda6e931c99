"""Sequence packing from the length histogram by non-negative least squares.

Documents are cut into full windows and a rest. Columns (two to DEEP lengths that fill a window exactly) are generated by
price: for each length and depth the combination with the most uncovered documents. Non-negative least squares gives how
often each is used, prices follow from what it leaves, and so on for ROUNDS rounds; counts are rounded and what is left
is packed greedily into full windows. Only what fits nowhere is laid end to end and cut at window
edges. All of the plan is in terms of lengths, so its size does not depend on the number of documents; ranks within a
length turn it into places.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import ship, written

SIZE = 4096
END = 2
#: Most lengths in a column, and rounds of pricing.
DEEP, ROUNDS = 8, 2
#: Bytes of runs and ids that a worker keeps, and bytes of texts in a group.
KEPT_BYTES, GROUP_BYTES = 24 << 20, 4 << 20
#: Longest word (bytes) for the merge matrix, and words in one matrix.
WIDEST, TALL = 64, 8192
PIECES = "uid long, part int, lrank long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
_LOADED: dict = {}
#: Runs that need no composition: visible ASCII but the apostrophe, and Latin letters whose lower case is one letter.
_LATIN = "^[\\x21-\\x26\\x28-\\x7e\\x{c0}-\\x{d6}\\x{d8}-\\x{f6}\\x{f8}-\\x{12f}\\x{131}-\\x{148}\\x{14a}-\\x{17f}]*$"
#: Class of each byte of such a run, lower-cased: letter (all of a multi-byte one), digit, other.
_LETTER, _DIGIT, _OTHER = 1, 2, 3
_CLASS = np.array([_LETTER if b > 127 or 97 <= b < 123 or 65 <= b < 91 else _DIGIT if 48 <= b < 58 else _OTHER for b in range(256)], np.int8)


def tokenizer(path: str):
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _LOADED[path] = Tokenizer.from_file(path)
    return _LOADED[path]


def _byte_chars() -> list[str]:
    """Stand-ins of the bytes 0-255: visible Latin-1 for itself, the rest from code point 256 on."""
    seen = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in seen else chr(next(rest)) for b in range(256)]


class Merges:
    """Byte-pair merges of many words at once: a matrix of symbols, a word a row, one merge a row and step.

    Each step merges the pair of least rank (the leftmost of equal ones) in every row that has one, and looks up the
    two pairs that this makes. Ranks lie in an open hash table.
    """

    NONE = np.iinfo(np.int32).max

    def __init__(self, vocab: dict[str, int], merges: list):
        chars = _byte_chars()
        self.first = np.array([vocab[c] for c in chars], np.int64)
        self.last = np.array([vocab[c + "</w>"] for c in chars], np.int64)
        self.void = max(vocab.values()) + 1
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        key = np.array([vocab[a] * (self.void + 1) + vocab[b] for a, b in pairs], np.int64)
        self.bits = max(len(pairs) * 4, 16).bit_length()
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, self.NONE, np.int32)
        at, todo = self._spot(key), np.arange(len(key))
        while len(todo):  # linear probing, a step for all that found their place taken
            free = self.keys[at[todo]] < 0
            self.keys[at[todo[free]]] = key[todo[free]]
            self.ranks[at[todo[free]]] = todo[free]
            lost = self.ranks[at[todo]] != todo
            at[todo[lost]] = (at[todo[lost]] + 1) & ((1 << self.bits) - 1)
            todo = todo[lost]
        a, b = np.divmod(np.arange(1 << 16), 256)
        self.inner = self.rank(self.first[a], self.first[b])  # of two bytes inside a word, and at its end
        self.final = self.rank(self.first[a], self.last[b])

    def _spot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * (self.void + 1) + b
        at = self._spot(key)
        held = self.keys[at]
        out = np.where(held == key, self.ranks[at], self.NONE)
        more = np.flatnonzero((held != key) & (held >= 0))
        while len(more):
            at[more] = (at[more] + 1) & ((1 << self.bits) - 1)
            held = self.keys[at[more]]
            hit = held == key[more]
            out[more[hit]] = self.ranks[at[more[hit]]]
            more = more[~hit & (held >= 0)]
        return out

    def _matrix(self, flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, row by row, and how many each has."""
        n, w = len(start), int(size.max()) + 2  # a void column on either side
        col = np.arange(w - 2)
        inside = col < size[:, None]
        byte = np.zeros((n, w), np.int64)
        byte[:, 1:-1][inside] = flat[(start[:, None] + col)[inside]]
        s = np.full((n, w), self.void, np.int64)
        s[:, 1:-1] = np.where(inside, self.first[byte[:, 1:-1]], self.void)
        at = np.arange(n)
        s[at, size] = self.last[byte[at, size]]
        r = np.full((n, w), self.NONE, np.int32)
        r[:, 1:-1] = np.where(col < size[:, None] - 1, self.inner[byte[:, 1:-1] << 8 | byte[:, 2:]], self.NONE)
        many = size > 1
        end = size[many] - 1
        r[at[many], end] = self.final[byte[at[many], end] << 8 | byte[at[many], end + 1]]
        after = np.tile(np.arange(1, w + 1, dtype=np.int32), (n, 1)).ravel()
        before = np.tile(np.arange(-1, w - 1, dtype=np.int32), (n, 1)).ravel()
        symbols, row = s.ravel(), np.arange(n, dtype=np.int64) * w
        while len(row):
            j = r.argmin(1)
            least = r[np.arange(len(r)), j]
            on = least < self.NONE
            if not on.all():
                row, r, j, least = row[on], r[on], j[on], least[on]
                if not len(row):
                    break
            here = row + j
            gone = row + after[here]
            new = self.made[least]
            symbols[here], symbols[gone] = new, self.void
            k = after[gone]
            after[here] = k
            past, prior = row + k, row + before[here]
            before[past] = j
            at = np.arange(len(row))
            r[at, gone - row] = self.NONE
            r[at, j] = self.rank(new, symbols[past])
            r[at, prior - row] = self.rank(symbols[prior], new)
        there = s != self.void
        return s[there], there.sum(1)

    def encode(self, flat: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the words flat[edge[i] : edge[i + 1]] (1 to WIDEST bytes): a pool, and where each word's lie in it."""
        size = np.diff(edge)
        order = np.argsort(size, kind="stable")
        pool, count = [np.zeros(0, np.int64)], np.zeros(len(size), np.int64)
        for i in range(0, len(order), TALL):
            part = order[i : i + TALL]
            ids, count[part] = self._matrix(flat, edge[:-1][part], size[part])
            pool.append(ids)
        begin = np.zeros(len(size), np.int64)
        begin[order] = np.cumsum(count[order]) - count[order]
        return np.concatenate(pool), begin, count


def gather(pool: np.ndarray, begin: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """pool[begin[i] : begin[i] + count[i]] end to end, and the edges of each."""
    edge = np.r_[0, np.cumsum(count)]
    spot = np.repeat((begin - edge[:-1]).astype(np.int32), count)
    spot += np.arange(edge[-1], dtype=np.int32)
    return pool[spot], edge


def _buffers(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and edges of a string array without nulls."""
    edge = np.frombuffer(a.buffers()[1], np.int32)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int32)
    return np.frombuffer(a.buffers()[2] or b"", np.uint8), edge


class Encoder:
    """Ids of texts by a vocabulary of byte pairs with word ends.

    The vocabulary drops white space and never joins across it, so texts are cut at blanks and line feeds, and each
    distinct run of a group of texts is encoded once. Runs of plain Latin characters are cut into words where the class
    of characters changes, and distinct words are merged many at a time; all other runs, contractions, special tokens
    and very long words go through the library. Runs kept from one group to the next are bounded by bytes; one table
    serves all tasks of a Python worker. Strings stay in Arrow's buffers.
    """

    _shared: dict = {}

    def __init__(self, path: str):
        self.tok = tokenizer(path)
        if path not in self._shared:
            with open(path, encoding="utf-8") as f:
                model = json.load(f)["model"]
            if model["type"] != "BPE" or model.get("end_of_word_suffix") != "</w>":
                raise ValueError("a vocabulary of byte pairs with word ends is needed")
            none = np.zeros(0, np.int64)
            self._shared[path] = Merges(model["vocab"], model["merges"]), {"runs": pa.array([], pa.string()), "pool": none.astype(np.int32), "begin": none, "count": none}
        self.merges, self.kept = self._shared[path]
        self.kind = "<u2" if self.tok.get_vocab_size(True) <= 1 << 16 else "<u4"

    def _plain(self, runs: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of plain Latin runs: pool, begin, count."""
        flat, edge = _buffers(pc.utf8_lower(runs))
        flat = flat[edge[0] : edge[-1]]
        edge = edge - edge[0]
        kind = _CLASS[flat]
        cut = np.ones(len(flat) + 1, bool)
        cut[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        cut[edge] = True
        at = np.flatnonzero(cut).astype(np.int32)
        words = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(flat)).dictionary_encode()
        which = np.asarray(words.indices)
        bytes_, ends = _buffers(words.dictionary)
        pool, begin, count = self.merges.encode(bytes_, ends)
        pool, done = gather(pool, begin[which], count[which])
        mine = done[np.searchsorted(at, edge)]  # edges of the runs
        return pool, mine[:-1], np.diff(mine)

    def learn(self, runs: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct runs: pool, begin, count."""
        fast = pc.and_(pc.match_substring_regex(runs, _LATIN), pc.less(pc.binary_length(runs), WIDEST))
        fast = np.asarray(pc.and_not(fast, pc.match_substring(runs, "<|")))
        begin, count = np.zeros(len(runs), np.int64), np.zeros(len(runs), np.int64)
        pool, begin[fast], count[fast] = self._plain(runs.filter(pa.array(fast)))
        pools, at = [pool.astype(np.int32)], len(pool)
        rest = np.flatnonzero(~fast)
        texts = runs.take(pa.array(rest)).to_pylist()
        for i in range(0, len(texts), 1000):
            for j, e in zip(rest[i : i + 1000].tolist(), self.tok.encode_batch_fast(texts[i : i + 1000], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, np.int32)
                pools.append(ids)
                begin[j], count[j] = at, len(ids)
                at += len(ids)
        return np.concatenate(pools), begin, count

    def _ids(self, runs: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct runs, kept ones first: pool, begin, count."""
        k = self.kept
        known = pc.index_in(runs, value_set=k["runs"])
        new = np.flatnonzero(np.asarray(known.is_null()))
        at = np.asarray(known.fill_null(0))
        begin, count = (k[x][at] if len(k["runs"]) else np.zeros(len(runs), np.int64) for x in ("begin", "count"))
        fresh = runs.take(pa.array(new))
        pool, b, c = self.learn(fresh)
        pool, begin[new], count[new] = np.concatenate([k["pool"], pool]), b + len(k["pool"]), c
        if pool.nbytes + k["runs"].nbytes + fresh.nbytes + 16 * (len(k["runs"]) + len(new)) <= KEPT_BYTES:
            k.update(runs=pa.concat_arrays([k["runs"], fresh]), pool=pool, begin=np.r_[k["begin"], begin[new]], count=np.r_[k["count"], c])
        else:  # the short ones of this group alone
            short = np.flatnonzero(np.asarray(pc.less_equal(pc.binary_length(runs), 32)))
            if 60 * len(short) > KEPT_BYTES:
                short = short[:0]
            kept, edge = gather(pool, begin[short], count[short])
            k.update(runs=runs.take(pa.array(short)), pool=kept, begin=edge[:-1], count=np.diff(edge))
        return pool, begin, count

    def many(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text (null: empty). Texts go in groups of a few megabytes: each distinct run is looked up once."""
        texts = texts.fill_null("")
        stop = np.cumsum(np.asarray(pc.binary_length(texts)), dtype=np.int64)
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(stop, (stop[at - 1] if at else 0) + GROUP_BYTES, "right")))
            cut = pc.split_pattern(pc.replace_substring(texts.slice(at, to - at), "\n", " "), " ")
            runs = cut.flatten().dictionary_encode()
            which, edge = np.asarray(runs.indices), np.asarray(cut.offsets) - cut.offsets[0].as_py()
            pool, begin, count = self._ids(runs.dictionary)
            ids, done = gather(pool.astype(self.kind), begin[which], count[which])
            ends = done[edge].tolist()
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                yield ids[a:b]
            at = to


def pieces(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", size: int = SIZE, end: int = END) -> DataFrame:
    """PIECES rows, written: full windows and the rest of each document; ids are kept for rests alone."""
    from pyspark import TaskContext

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        enc, n, seen = Encoder(path), 0, np.zeros(size + 1, np.int64)
        for b in batches:
            out = []
            for d, ids in zip(b.column(0).to_pylist(), enc.many(b.column(1)), strict=True):
                total = len(ids) + 1
                wide = np.empty(total, "<u4")
                wide[:-1], wide[-1] = ids, end
                for at in range(0, total, size):
                    m = min(size, total - at)
                    out.append((part << 33 | n, part, int(seen[m]), d, at, m, zlib.crc32(wide[at : at + m]), total, wide[at:].astype(enc.kind).tobytes() if m < size else None))
                    seen[m] += 1
                    n += 1
            cols = list(zip(*out, strict=True)) if out else [()] * 9
            kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 6, pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])

    ship(docs.sparkSession)
    return written(docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(run, PIECES), "pieces")


def columns(price: np.ndarray, on: np.ndarray, size: int, deep: int) -> np.ndarray:
    """For each length that is on and each depth from 2 to deep, the combination filling size with the highest price.

    A row a combination: ascending lengths, zeros in front. Prices of sums follow from those of shorter sums.
    """
    one = np.where(on, price, -np.inf)
    have = np.flatnonzero(on)
    best, part = [one], [np.arange(size + 1)]
    out = []
    for d in range(1, deep):
        s = size - have
        rows = np.zeros((len(have), deep), np.int64)
        rows[:, 0] = have
        ok = np.isfinite(best[d - 1][s])
        for k in range(d - 1, -1, -1):  # the sum's parts, one depth after the other
            a = part[k][s]
            rows[:, 1 + k] = a
            s = np.maximum(s - a, 0)
        out.append(np.sort(rows[ok], axis=1))
        if d < deep - 1:
            top, arg = np.full(size + 1, -np.inf), np.zeros(size + 1, np.int64)
            for a in have.tolist():
                c = one[a] + best[d - 1][: size + 1 - a]
                up = c > top[a:]
                top[a:][up] = c[up]
                arg[a:][up] = a
            best.append(top)
            part.append(arg)
    return np.concatenate(out) if out else np.zeros((0, deep), np.int64)


def nnls(pats: np.ndarray, hist: np.ndarray, start: np.ndarray, rounds: int = 200) -> np.ndarray:
    """x >= 0 with least |A x - hist|, A the patterns' length counts: projected gradient with momentum."""
    if not len(pats):
        return np.zeros(0)
    col, n = np.nonzero(pats)[0], len(hist)
    row = pats[pats > 0]
    mul = lambda x: np.bincount(row, x[col], minlength=n)
    back = lambda r: np.bincount(col, r[row], minlength=len(pats))
    v = np.ones(len(pats))
    for _ in range(20):
        v = back(mul(v))
        v /= np.linalg.norm(v)
    step = 1 / (np.linalg.norm(back(mul(v))) * 1.05)
    x = old = start
    for k in range(rounds):
        u = x + k / (k + 3) * (x - old)
        old, x = x, np.maximum(0, u - step * back(mul(u) - hist))
    return x


def fill(left: np.ndarray, room: int) -> list[int]:
    """Lengths of left that together make room exactly, found greedily; empty if none are found.

    The longest that fits is tried with one or two others that close the gap; else it is taken and the rest filled on.
    """
    out: list[int] = []
    left = left.copy()
    while room:
        have = np.flatnonzero(left[: room + 1])
        if not len(have):
            return []
        if have[-1] == room:
            return [*out, int(have[-1])]
        a = have[have * 2 <= room]
        b = have[np.maximum(np.searchsorted(have, room - a, "right") - 1, 0)]  # the longest beside a
        ok = (a + b == room) & ((a != b) | (left[a] > 1))
        if ok.any():
            i = int(np.flatnonzero(ok)[-1])
            return [*out, int(a[i]), int(b[i])]
        out.append(int(have[-1]))
        left[have[-1]] -= 1
        room -= int(have[-1])
    return out


def sweep(left: np.ndarray, size: int) -> dict[tuple[int, ...], int]:
    """Windows found greedily, the longest piece first, each as often as its lengths repeat; left is used up in place."""
    out: dict[tuple[int, ...], int] = {}
    for a in range(size - 1, 0, -1):
        while left[a]:
            left[a] -= 1
            more = fill(left, size - a)
            left[a] += 1
            if not more:
                break
            p = (a, *more)
            n = int(min(left[x] // p.count(x) for x in set(p)))
            out[p] = out.get(p, 0) + n
            for x in p:
                left[x] -= n
    return out


def solve(hist: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns and how often each is used (real numbers), by rounds of pricing and least squares.

    The first columns are those of a greedy sweep of at most DEEP lengths; their counts come from least squares alone.
    """
    goal = hist.astype(float)
    goal[size] = 0
    on = goal > 0
    found = [sorted([*p, *[0] * (DEEP - len(p))]) for p in sweep(goal.astype(np.int64), size) if len(p) <= DEEP]
    pats, left, rng = np.array(found, np.int64).reshape(-1, DEEP), goal, np.random.default_rng(7)
    x = np.zeros(len(pats))
    for k in range(ROUNDS + 1):
        if k:
            some = rng.random(len(left)) < 0.3  # parts come from a third of the lengths, so that columns differ
            keep = x > 1e-9
            every = np.concatenate([pats[keep], columns(np.where(some, left, left.min() - 1), on, size, DEEP)])
            pats, at = np.unique(every, axis=0, return_inverse=True)
            start = np.zeros(len(pats))
            np.add.at(start, at.ravel()[: int(keep.sum())], x[keep])
            x = start
        x = nnls(pats, goal, x)
        left = goal - np.bincount(pats.ravel(), np.repeat(x, DEEP), minlength=len(goal))
        left[0] = 0
    return pats, x


@dataclass
class Plan:
    """Segments sorted by (length, first rank): a run of ranks goes to base, base+1, ... at one offset, or, with
    base -1, end to end into the stream of cut windows from position `offset`."""

    length: np.ndarray
    rank: np.ndarray
    base: np.ndarray
    offset: np.ndarray
    tail: int  # first sequence of the stream
    shares: dict  # pieces by how they were placed: full windows, columns, greedy, stream


def plan(hist: np.ndarray, size: int = SIZE) -> Plan:
    left = hist.astype(np.int64).copy()
    left[0] = 0
    used: dict[tuple[int, ...], int] = {(size,): int(left[size])} if left[size] else {}
    left[size] = 0
    shares = {"full": int(hist[size]), "columns": 0, "greedy": 0}

    def take(p: tuple[int, ...], most: int) -> None:
        n = int(min([most, *[left[a] // p.count(a) for a in set(p)]]))
        if n > 0:
            used[p] = used.get(p, 0) + n
            shares["columns"] += n * len(p)
            for a in p:
                left[a] -= n

    pats, x = solve(left, size)
    order = np.argsort(-x, kind="stable")
    order = order[x[order] > 1e-6]
    rows = [tuple(a for a in p if a) for p in pats[order].tolist()]
    for p, n in zip(rows, x[order].tolist(), strict=True):
        take(p, int(n + 0.5))
    for p in rows:
        take(p, 1 << 62)
    for p, n in sweep(left, size).items():  # what rounding left
        used[p] = used.get(p, 0) + n
        shares["greedy"] += n * len(p)
    rows, at, spent = [], 0, np.zeros(size + 1, np.int64)
    for p, n in sorted(used.items()):
        off = 0
        for a in p:
            rows.append((a, int(spent[a]), at, off))
            spent[a] += n
            off += a
        at += n
    pos = 0
    shares["stream"] = int(left.sum())
    for a in np.flatnonzero(left)[::-1]:
        rows.append((int(a), int(spent[a]), -1, pos))
        pos += int(a) * int(left[a])
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 4).T
    return Plan(*cols, tail=at, shares=shares)


def assign(length: np.ndarray, rank: np.ndarray, p: Plan, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece; those in the stream may run over the end of a window."""
    wide = np.int64(1) << 44
    i = np.searchsorted(p.length * wide + p.rank, length * wide + rank, "right") - 1
    past = rank - p.rank[i]
    pos = p.offset[i] + past * length
    stream = p.base[i] < 0
    return np.where(stream, p.tail + pos // size, p.base[i] + past), np.where(stream, pos % size, p.offset[i])


def pack(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", size: int = SIZE, end: int = END) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every id of every row, with `end` after each, lies in exactly one piece; null text is empty (the end id alone).
    Only the last sequence can have padding. Repeated rows are packed each; null keys stay null; other columns are
    ignored. path must name the tokenizer file on every machine.
    """
    got = pieces(docs, path, key, text, size, end)
    narrow = got.drop("ids")
    per = narrow.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    # one row a (length, task): a window by length has as many rows as there were tasks
    before = per.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("length", "part", "before")
    hist = np.zeros(size + 1, np.int64)
    for a, n in per.groupBy("length").agg(F.sum("n")).collect():  # at most `size` rows
        hist[a] = n
    p = plan(hist, size)
    schema = "uid long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, skip long"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            length = np.asarray(col["length"])
            if not len(length):
                continue
            seq, off = assign(length, np.asarray(col["lrank"]) + np.asarray(col["before"]), p, size)
            over = np.flatnonzero(off + length > size)
            first = np.minimum(length, size - off)
            pick = np.r_[np.arange(len(length)), over]
            skip = np.r_[np.zeros(len(length), np.int64), first[over]]
            crc = pa.array(np.asarray(col["ids_crc32"])[pick], mask=np.isin(pick, over))
            start = np.asarray(col["start"])
            yield pa.RecordBatch.from_arrays([
                col["uid"].take(pa.array(pick)), col["doc_id"].take(pa.array(pick)), pa.array(start[pick] + skip), pa.array(np.r_[first, (length - first)[over]]), crc,
                col["doc_tokens"].take(pa.array(pick)), pa.array(np.r_[seq, seq[over] + 1]), pa.array(np.r_[off, np.zeros(len(over), np.int64)]), pa.array(skip)],
                names=[x.split()[0] for x in schema.split(", ")])

    placed = written(narrow.join(before, ["length", "part"]).mapInArrow(place, schema), "placed")
    kind = "<u2" if tokenizer(path).get_vocab_size(True) <= 1 << 16 else "<u4"

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i = b.schema.get_field_index("ids")
            crc = [zlib.crc32(np.frombuffer(raw, kind)[s : s + n].astype("<u4").tobytes()) for raw, s, n in zip(b.column(i).to_pylist(), b.column("skip").to_pylist(), b.column("length").to_pylist(), strict=True)]
            j = b.schema.get_field_index("ids_crc32")
            yield b.set_column(j, "ids_crc32", pa.array(crc, pa.int64())).select([x.split()[0] for x in schema.split(", ")])

    cut = placed.where("ids_crc32 IS NULL").join(got.select("uid", "ids"), "uid").mapInArrow(sums, schema)
    return placed.where("ids_crc32 IS NOT NULL").unionByName(cut).select(F.col("doc_id").alias(key), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
