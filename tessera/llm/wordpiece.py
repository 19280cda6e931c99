"""Token counts: greedy longest-match word pieces, counted by a linear automaton.

The vocabulary is a trie. Where a match can grow no further, the node's failure link tells which node the rest of the
text stands at after the longest pieces were taken off, and how many pieces that took. Pieces are never built.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import ship

#: Bytes of words that a task keeps, counted with the objects that hold them.
MEMO_BYTES, ENTRY_BYTES = 40 << 20, 140
DEAD = -1
_BUILT: dict[str, "Automaton"] = {}


class Automaton:
    """Counts the pieces of a word: pieces may follow each other anywhere, and the word is closed by an end mark.

    vocab: byte strings over 0-255; a piece that closes a word ends with the symbol END. A word that cannot be cut
    counts as one unknown piece.
    """

    END = 256

    def __init__(self, vocab: list[tuple[int, ...]]):
        self.next: list[dict[int, int]] = [{}]
        self.piece = [0]
        depth = [0]
        for t in vocab:
            at = 0
            for c in t:
                to = self.next[at].get(c)
                if to is None:
                    to = len(self.next)
                    self.next[at][c] = to
                    self.next.append({})
                    self.piece.append(0)
                    depth.append(depth[at] + 1)
                at = to
            self.piece[at] = len(t)
        # breadth first: link and popped count of each node
        self.link, self.popped = [DEAD] * len(self.next), [0] * len(self.next)
        level = [0]
        while level:
            below = []
            for u in level:
                for c, v in self.next[u].items():
                    if self.piece[v]:
                        self.link[v], self.popped[v] = 0, 1
                    else:
                        z, n = self.link[u], self.popped[u]
                        while z != DEAD and c not in self.next[z]:
                            z, n = self.link[z], n + self.popped[z]
                        if z != DEAD:
                            self.link[v], self.popped[v] = self.next[z][c], n
                    below.append(v)
            level = below

    def count(self, word: bytes) -> int:
        """Pieces of one word; 1 where the vocabulary cannot spell it; 0 for no bytes."""
        if not word:
            return 0
        nxt, link, popped = self.next, self.link, self.popped
        u = n = 0
        for c in (*word, self.END):
            while (to := nxt[u].get(c)) is None:
                n += popped[u]
                u = link[u]
                if u == DEAD:
                    return 1
            u = to
        while u:
            n += popped[u]
            u = link[u]
            if u == DEAD:
                return 1
        return n


def _byte_chars() -> dict[str, int]:
    """Printable stand-ins of byte-level vocabularies: visible Latin-1 for itself, the rest from code point 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(rest)}


def load(path: str) -> Automaton:
    """The automaton of a byte-level vocabulary file with </w> word ends; built once in each Python worker."""
    if path not in _BUILT:
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        chars, out = _byte_chars(), []
        for t in vocab:
            end = t.endswith("</w>") and len(t) > 4
            out.append((*[chars[c] for c in (t[:-4] if end else t)], *[Automaton.END] * end))
        _BUILT[path] = Automaton(out)
    return _BUILT[path]


def counts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_words, n_tokens. Words are runs without ASCII white space, lower-cased (U+00A0, U+3000 and
    other blanks beyond ASCII do not part words).

    Null text counts as empty: 0 and 0. Whole texts are read; repeated rows each come back; other columns are ignored.
    path must name the vocabulary file on every machine.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto, memo, held = load(path), {}, 0
        for b in batches:
            words, tokens = [], []
            for t in b.column(1).to_pylist():
                ws = (t or "").lower().encode("utf-8", "surrogatepass").split()
                try:
                    n = sum([memo[w] for w in ws])
                except KeyError:
                    if held > MEMO_BYTES:
                        memo.clear()
                        held = 0
                    long = 0
                    for w in ws:
                        if w not in memo:
                            if len(w) > 64:  # long words come back least: they are counted and not kept
                                long += auto.count(w)
                                continue
                            memo[w] = auto.count(w)
                            held += len(w) + ENTRY_BYTES
                    n = long + sum([memo[w] for w in ws if len(w) <= 64])
                words.append(len(ws))
                tokens.append(n)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=[key, "n_words", "n_tokens"])

    ship(docs.sparkSession)
    d = docs.select(F.col(key), F.col(text))
    return d.mapInArrow(run, f"`{key}` {d.schema[0].dataType.simpleString()}, n_words long, n_tokens long")
