"""Toxicity by weak supervision: voters, a generative label model, and a linear classifier on its posteriors.

Voters are lexicon entries and patterns. Lexicon entries come from a fixed list, from word families that burst (three or
more different words with one beginning in one text, more often than chance; found without labels), and from words that stand
out; which of them vote, and for which class, is settled on labelled rows. The label model never sees a label: it starts
from the number of votes, and expectation-maximisation estimates each voter's rate in either class and the pairwise
correlations that the classes leave, which scale voters that repeat each other. A sparse logistic regression on word
features then learns the posteriors and scores whole texts. Labels check the outcome: `departure` is the share of labelled
rows where the posterior and the label differ.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import ship, written

#: At most so many labelled rows are fitted on (those with the least hash of their id). A documented bound.
MAX_FIT_ROWS = 6_000
THRESHOLD = 0.3
#: Common insults, a voter each.
SEEDS = ("idiot", "moron", "stupid", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "clown")
#: Words of address, for the pattern voter.
COPULAS = ("you", "is", "are", "est", "ist", "es")
#: Distinct words of the fitted rows, in bytes, at most. A documented bound.
MAX_FIT_BYTES = 64 << 20
#: How much more often than chance a family of words must burst.
BURST = 10
#: A family may stay so far under the bound 2 ln(families tried) on the likelihood ratio (about half a false one is expected).
SLACK = 2.0
#: Share of the positive rows that a lexicon entry must be in.
LEAST_SHARE = 0.012
MEMO = 300_000
LETTERS = (3, 4, 5, 6, 7)
_WORD = re.compile(r"[^\W\d_]+")


def words_of(chunk: str) -> list[str]:
    return _WORD.findall(chunk.lower())


def base_features(word: str) -> list[str]:
    """A word and its first 3 to 7 letters (marked ^)."""
    return [word, *["^" + word[:n] for n in LETTERS if len(word) >= n]]


def feature_set(words: set[str]) -> set[str]:
    """Features of a text's distinct words; a beginning that two or three words share counts again (#2, #3)."""
    n = Counter(f for w in words for f in base_features(w))
    return {*n, *[f"{f}#2" for f, k in n.items() if k > 1], *[f"{f}#3" for f, k in n.items() if k > 2]}


def all_words(text: str | None) -> set[str]:
    return {w for c in set((text or "").split()) for w in words_of(c)}


@dataclass
class LabelModel:
    """Class prior, voter rates in either class, correlations within the classes, and the voter weights these give."""

    prior: float
    hit: np.ndarray
    false: np.ndarray
    correlation: np.ndarray
    weight: np.ndarray  # 1: a voter that repeats no other
    abstain: bool = False  # a voter that does not vote says nothing; else it votes for the other class

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        z = math.log(self.prior / (1 - self.prior)) + (votes * np.log(self.hit / self.false)) @ self.weight
        if not self.abstain:
            z = z + ((1 - votes) * np.log((1 - self.hit) / (1 - self.false))) @ self.weight
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_labels(votes: np.ndarray, start: np.ndarray | None = None, rounds: int = 25, abstain: bool = False) -> LabelModel:
    """Expectation-maximisation from the number of votes (or a start posterior); no labels enter.

    Without a start posterior, the last voter stands for rows that no other voter votes on; they start as clean.

    A voter's rates are smoothed by half a row. Each round estimates the correlations again; m voters that
    always agree get a weight of 1/m each, by the inverse of the correlation matrix.
    """
    n, v = votes.shape
    p = np.where(votes[:, -1] > 0, 0.02, 1 - 0.3 ** votes.sum(1)) if start is None else start.astype(float)
    model = LabelModel(0.1, np.full(v, 0.5), np.full(v, 0.05), np.eye(v), np.ones(v), abstain)
    for k in range(rounds):
        pos, neg = p.sum(), n - p.sum()
        hit, false = (p @ votes + 0.5) / (pos + 1), ((1 - p) @ votes + 0.05) / (neg + 1)
        cor, weight = model.correlation, model.weight
        if k >= rounds // 3 and v > 1:
            within = (p[:, None] * (votes - hit) ** 2 + (1 - p)[:, None] * (votes - false) ** 2).mean(0)
            cross = ((votes - hit) * p[:, None]).T @ (votes - hit) + ((votes - false) * (1 - p)[:, None]).T @ (votes - false)
            sd = np.sqrt(within) + 1e-6
            cor = np.clip(cross / n / sd[:, None] / sd[None, :], 0, 1)
            cor[cor < 0.3] = 0  # below: chance, at these row counts
            np.fill_diagonal(cor, 1)
            weight = np.clip(np.linalg.solve(cor + 0.05 * np.eye(v), np.ones(v) * 1.05), 1 / (cor > 0).sum(1), 1)
        model = LabelModel(float(np.clip(p.mean(), 1e-3, 0.999)), np.clip(hit, 1e-4, 1 - 1e-4), np.clip(false, 1e-5, 1 - 1e-4), cor, weight)
        p = model.posterior(votes)
    return model


def _apart(texts: list[str], y: np.ndarray) -> tuple[list[str], np.ndarray]:
    """One row of each group of near copies with one label: rows whose four least word hashes agree.

    A toxic text that was copied often would else make all its words stand out.
    """
    seen, keep = set(), []
    for i, t in enumerate(texts):
        mark = (y[i], *sorted({zlib.crc32(w.encode()) for w in t.split()})[:4])
        if mark not in seen:
            seen.add(mark)
            keep.append(i)
    return [texts[i] for i in keep], y[keep]


def mine(texts: list[str], y: np.ndarray) -> list[str]:
    """Features that stand for label 1 beyond chance over all features tried (likelihood-ratio test), best first.

    texts: the distinct words of each, joined by blanks. Features are counted in the positive texts first; the others are read for
    those alone that a share of the positive texts has, so memory follows that share.
    """
    rate = float(np.clip(y.mean(), 1e-4, 1 - 1e-4)) if len(y) else 0.5
    pos: Counter = Counter()
    for t, label in zip(texts, y, strict=True):
        if label:
            pos.update(feature_set(set(t.split())))
    tried = len(pos)
    pos = Counter({f: a for f, a in pos.items() if a >= max(3, LEAST_SHARE * y.sum())})
    every = Counter(pos)
    for t, label in zip(texts, y, strict=True):
        if not label:
            every.update(f for f in feature_set(set(t.split())) if f in pos)
    limit = 2 * math.log(max(tried, 2))
    scored = []
    for f, a in pos.items():
        n = every[f]
        if a / n <= 1.5 * rate:
            continue
        b = n - a
        g = 2 * (a * math.log(a / (n * rate)) + (b * math.log(b / (n * (1 - rate))) if b else 0))
        if g > limit:
            scored.append((-g, -len(f), f))
    out, stems = [], set()
    for _, _, f in sorted(scored):  # of nested beginnings the one that tells most, of equal ones the longest
        stem = f.strip("^").partition("#")[0]
        if not any(stem.startswith(s) or s.startswith(stem) for s in stems):
            out.append(f)
            stems.add(stem)
        elif "#" in f and f"^{stem}" in out:
            out.append(f)
    return out


def bursts(texts: list[str]) -> list[str]:
    """Beginnings (with #2: at least two different words) that burst, without labels: in two or more texts three different
    words share it, and that is ten times the count that its rate over all texts would give."""
    total, heavy, size = Counter(), Counter(), []
    for t in texts:
        words = t.split()
        size.append(len(words))
        n = Counter(w[:k] for w in words for k in LETTERS[2:] if len(w) >= k)
        total.update(n)
        heavy.update(f for f, m in n.items() if m >= 3)
    length, out = np.array(size, float), []
    for f, m in heavy.items():
        if m >= 2:
            rate = total[f] / length.sum() * length
            chance = float((1 - np.exp(-rate) * (1 + rate + rate**2 / 2)).sum())
            if m > BURST * chance:
                out.append((-m / max(chance, 1e-9), f))
    return [f"^{f}#2" for _, f in sorted(out)]


def telling(features: list[str], sets: list[set[str]], y: np.ndarray) -> list[str]:
    """Of nested features those that stand for label 1 beyond chance over all that are tried, the longest of equal ones."""
    rate = float(np.clip(y.mean(), 1e-4, 1 - 1e-4))
    seen, pos = Counter(), Counter()
    want = set(features)
    for s, label in zip(sets, y, strict=True):
        hit = s & want
        seen.update(hit)
        if label:
            pos.update(hit)
    scored = []
    for f in features:
        n, a = seen[f], pos[f]
        if a >= 2 and a / n > 1.5 * rate:
            b = n - a
            g = 2 * (a * math.log(a / (n * rate)) + (b * math.log(b / (n * (1 - rate))) if b else 0))
            if g > 2 * math.log(max(len(features), 2)) - SLACK:
                scored.append((-g, -len(f), f))
    out, stems = [], set()
    for _, _, f in sorted(scored):
        stem = f.strip("^").partition("#")[0]
        if not any(stem.startswith(s) or s.startswith(stem) for s in stems):
            out.append(f)
            stems.add(stem)
    return out


@dataclass
class Model:
    """Weights by feature; +1, +2 and +3 stand for so many different lexicon entries in a text, or more."""

    weights: dict[str, float]
    bias: float
    lexicon: frozenset[str] = frozenset()
    departure: float = 0.0

    def score(self, words: set[str]) -> float:
        """Chance of label 1; words without a known feature change nothing."""
        found = counted(feature_set(words), self.lexicon)
        z = self.bias + sum(sorted(self.weights[f] for f in found if f in self.weights))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def counted(found: set[str], lexicon: frozenset[str]) -> set[str]:
    """found and the marks of how many lexicon entries are in it."""
    return found | {f"+{k}" for k in range(1, min(3, len(found & lexicon)) + 1)}


def _logistic(rows: list[np.ndarray], n: int, target: np.ndarray, rounds: int = 800, rate: float = 1.0, l1: float = 1e-5, l2: float = 1e-6) -> tuple[np.ndarray, float]:
    """Sparse logistic regression on soft targets: proximal gradient with momentum over binary features."""
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    feat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    count = np.bincount(feat, minlength=n) + 1.0
    w, old = np.zeros(n), np.zeros(n)
    bias = old_b = math.log(max(target.mean(), 1e-3) / max(1 - target.mean(), 1e-3))
    m = max(len(rows), 1)
    step = rate * m / (count + 0.02 * m)  # rare features move as far as common ones
    for k in range(rounds):
        mom = k / (k + 3)
        u, b = w + mom * (w - old), bias + mom * (bias - old_b)
        z = b + np.bincount(doc, u[feat], minlength=len(rows))
        off = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - target
        grad = np.bincount(feat, off[doc], minlength=n) / m + l2 * u
        old, old_b = w, bias
        w = u - step * grad
        w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
        bias = b - rate * off.mean()
    return w, float(bias)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", most: int = MAX_FIT_ROWS) -> Model:
    """A model from at most `most` labelled rows of at most MAX_FIT_BYTES of different words, in the order of a hash of the id.

    None of them is held out (crc32 of the id as text, modulo 4, is 2). Of rows with one id the least text counts, of labels
    of one id the greatest.
    """
    lab = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & (F.crc32(F.col(key).cast("string").cast("binary")) % 4 != 2))
    lab = lab.groupBy(F.col(key)).agg(F.max(F.col(label)).cast("int").alias("y")).orderBy(F.xxhash64(key), key).limit(most)
    got = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("t")).join(F.broadcast(lab), key)  # at most `most` ids
    got = got.groupBy(key).agg(F.min("t").alias("t"), F.max("y").alias("y")).select(F.xxhash64(key).alias("h"), F.col(key).alias("id"), "y", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = pa.array([" ".join(sorted(all_words(t))) for t in b.column(3).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], words], names=["h", "id", "y", "words"])

    ship(docs.sparkSession)
    kind = docs.select(key).schema[0].dataType.simpleString()
    rows = written(got.mapInArrow(run, f"h long, id {kind}, y int, words string"), "toxicity-rows")
    size, last = 0, None
    for h, n in rows.select("h", F.octet_length("words")).orderBy("h").collect():  # at most `most` rows of two numbers
        size += n
        if size > MAX_FIT_BYTES:
            break
        last = h
    if last is None:
        return learn([], np.zeros(0))
    some = sorted(rows.where(F.col("h") <= last).collect())
    return learn([r["words"] for r in some], np.array([r["y"] for r in some], float))


def learn(texts: list[str], y: np.ndarray) -> Model:
    """The model from the distinct words of each text (joined by blanks) and labels 0 or 1."""
    texts, y = _apart(texts, y)
    if not len(y) or y.sum() == 0:
        return Model({s: 1.0 for s in SEEDS} | {"+1": 3.0}, -3.0, frozenset(SEEDS))
    families, words = bursts(texts), mine(texts, y)
    told = {*families, *words, *SEEDS, *COPULAS}
    sets = [feature_set(set(t.split())) & told for t in texts]
    lexicon, stems = [], set()
    for f in (*words, *telling(families, sets, y), *SEEDS):  # one entry a stem
        stem = f.strip("^").partition("#")[0]
        if not any(stem.startswith(s) or s.startswith(stem) for s in stems):
            lexicon.append(f)
            stems.add(stem)
    entries, copulas = frozenset(lexicon), set(COPULAS)
    sets = [counted(s, entries) for s in sets]
    patterns = [lambda s: "+2" in s, lambda s: "+3" in s, lambda s: "+1" in s and bool(copulas & s)]
    columns = [np.array([f in s for s in sets], float) for f in lexicon] + [np.array([v(s) for s in sets], float) for v in patterns]
    votes = np.stack(columns, axis=1)
    votes = np.c_[votes[:, votes.any(0)], ~votes.any(1)]  # the last voter: no sign at all
    if votes[:, -1].all():
        return Model({s: 1.0 for s in SEEDS} | {"+1": 3.0}, -3.0, frozenset(SEEDS))
    target = fit_labels(votes, abstain=True).posterior(votes)
    index = {f: i for i, f in enumerate(["+1", "+2", "+3", *lexicon])}
    rows = [np.array(sorted(index[f] for f in s if f in index), np.int64) for s in sets]
    w, bias = _logistic(rows, len(index), target)
    return Model({f: float(w[i]) for f, i in index.items() if w[i]}, bias, entries, float(((target >= 0.5) != (y > 0)).mean()))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", to: str = "score") -> DataFrame:
    """docs' columns and the score of each whole text (0 to 1). Null text scores as empty; no other column is read."""
    ship(docs.sparkSession)
    docs = docs.drop(to)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, memo = {f.partition("#")[0] for f in (*model.weights, *model.lexicon)}, {}
        for b in batches:
            out = []
            for t in b.column(at).to_pylist():
                found: set[str] = set()
                for c in set((t or "").split()):
                    hit = memo.get(c)
                    if hit is None:
                        if len(memo) > MEMO:
                            memo.clear()
                        hit = tuple(w for w in words_of(c) if not known.isdisjoint(base_features(w)))
                        if len(c) < 64:
                            memo[c] = hit
                    if hit:
                        found.update(hit)
                out.append(model.score(found))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.float64())], names=[*b.schema.names, to])

    return docs.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", `{to}` double")
