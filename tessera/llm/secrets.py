"""Secret scan in DataFrame functions alone.

Fixed patterns give the base spans. The method adds spans: candidate strings are slid over with a window, the
Shannon entropy of each window is kept by incremental counts (one character in, one out), separately for the
hexadecimal and the general class, and strings on the allow list are passed over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kind, pattern, least length, the group whose length counts.
BASE = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    ("access", r"AKIA[A-Z0-9]+", 20, 0),
    ("hex", r"[0-9a-f]{24,}", 24, 0),
)
WINDOW = 20
#: A run of the alphabet that holds a digit, found at its start only, so that long runs cost linear time.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{20,}+"
#: Bits a character over a window, for each class.
BITS = {"entropy_hex": 2.9, "entropy_text": 3.8}
#: Candidates that match are no secrets: placeholders, runs of the alphabet, UUIDs, dates, paths.
ALLOW = r"(?i)example|placeholder|abcdefgh|01234567|12345678|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|^[0-9-]+$|(/[a-z_-]+){3}"
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_text")
SPAN = "STRUCT<start: INT, ord: INT, stop: INT, kind: STRING, piece: STRING>"


def _spans(text: Column, pattern: str, kind: str, least: int, group: int) -> Column:
    """array<SPAN> of the matches that pass, in code points: gaps from split(), matches from regexp_extract_all()."""
    m = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    counted = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else m
    gaps = F.split(text, pattern, -1)
    none = F.expr(f"CAST(array() AS ARRAY<{SPAN}>)")
    start = F.struct(F.lit(0).alias("pos"), none.alias("out"))
    rows = F.arrays_zip(gaps.alias("gap"), m.alias("m"), counted.alias("v"))

    def step(a: Column, r: Column) -> Column:
        begin = a["pos"] + F.length(r["gap"])
        end = begin + F.coalesce(F.length(r["m"]), F.lit(0))
        span = F.struct(begin.alias("start"), F.lit(KINDS.index(kind)).alias("ord"), end.alias("stop"), F.lit(kind).alias("kind"), r["m"].alias("piece"))
        keep = r["m"].isNotNull() & (F.length(r["v"]) >= least)
        return F.struct(end.alias("pos"), F.when(keep, F.concat(a["out"], F.array(span))).otherwise(a["out"]).alias("out"))

    return F.when(F.rlike(text, F.lit(pattern)), F.aggregate(rows, start, step, lambda a: a["out"])).otherwise(none)


def best_entropy(s: Column, window: int = WINDOW) -> Column:
    """Highest Shannon entropy (bits a character) of any window of s; shorter strings are one window.

    Counts by character and the sum of c log2 c change by one character in and one out for each step.
    """
    def f(c: Column) -> Column:
        return F.when(c > 0, c * F.log2(c)).otherwise(F.lit(0.0))

    zero = F.transform(F.sequence(F.lit(0), F.lit(127)), lambda i: F.lit(0))
    size = F.least(F.length(s), F.lit(window))
    state = F.struct(zero.alias("c"), F.lit(0.0).alias("s"), F.lit(0.0).alias("best"))

    def step(a: Column, i: Column) -> Column:
        came = F.ascii(F.substr(s, i, F.lit(1)))
        went = F.when(i > window, F.ascii(F.substr(s, i - window, F.lit(1)))).otherwise(F.lit(-1))
        had = F.get(a["c"], came)
        lost = F.when(went >= 0, F.get(a["c"], F.greatest(went, F.lit(0)))).otherwise(F.lit(0))
        same = came == went
        total = F.when(same, a["s"]).otherwise(a["s"] - f(had) + f(had + 1) - f(lost) + f(lost - 1))
        counts = F.transform(a["c"], lambda c, k: c + F.when(k == came, 1).otherwise(0) - F.when(k == went, 1).otherwise(0))
        bits = F.log2(size.cast("double")) - total / size
        return F.struct(counts.alias("c"), total.alias("s"), F.when(i >= size, F.greatest(a["best"], bits)).otherwise(a["best"]).alias("best"))

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), state, step, lambda a: a["best"])


def scan(docs: DataFrame, text: str = "text", to: str = "secret_spans") -> DataFrame:
    """docs with a column of spans: array of (start, ord, stop, kind, piece) by start, then kind.

    Null text is the empty text and has no spans. Positions are code points, stop exclusive. All columns stay (an old `to`
    is replaced); rows that repeat each come back.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    base = F.concat(*[_spans(t, p, k, n, g) for k, p, n, g in BASE])
    own = unused("found", docs.columns)
    df = docs.withColumn(own, F.struct(base.alias("base"), _spans(t, CANDIDATE, "entropy_text", 20, 0).alias("cand")))
    base, cand = F.col(own)["base"], F.col(own)["cand"]
    free = F.filter(cand, lambda c: ~F.rlike(c["piece"], F.lit(ALLOW)) & ~F.exists(base, lambda b: (b["start"] <= c["start"]) & (b["stop"] >= c["stop"])))
    isx = lambda c: F.rlike(c["piece"], F.lit("^[0-9A-Fa-f-]+$"))
    high = F.filter(free, lambda c: best_entropy(c["piece"]) >= F.when(isx(c), F.lit(BITS["entropy_hex"])).otherwise(F.lit(BITS["entropy_text"])))
    named = F.transform(high, lambda c: F.struct(c["start"].alias("start"), F.when(isx(c), 3).otherwise(4).alias("ord"), c["stop"].alias("stop"), F.when(isx(c), F.lit("entropy_hex")).otherwise(F.lit("entropy_text")).alias("kind"), c["piece"].alias("piece")))
    return df.withColumn(to, F.when(F.size(base) + F.size(cand) > 0, F.array_sort(F.concat(base, F.when(F.size(cand) > 0, named).otherwise(cand)))).otherwise(base)).drop(own)


def unused(name: str, names: list[str]) -> str:
    """name, made longer until no column has it."""
    taken = {n.lower() for n in names}
    while name in taken:
        name += "_"
    return name


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """docs with every span (overlaps merged) replaced by mask; texts without spans stay as they are, null included."""
    own = unused("spans", docs.columns)
    df = scan(docs, text, own)
    state = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        fresh = s["start"] >= a["pos"]
        gap = F.when(fresh, F.concat(a["out"], F.substr(F.col(text), a["pos"] + 1, F.greatest(s["start"] - a["pos"], F.lit(0))), F.lit(mask))).otherwise(a["out"])
        return F.struct(F.greatest(a["pos"], s["stop"]).alias("pos"), gap.alias("out"))

    masked = F.aggregate(own, state, step, lambda a: F.concat(a["out"], F.substr(F.col(text), a["pos"] + 1, F.length(text))))
    return df.withColumn(text, F.when(F.size(own) > 0, masked).otherwise(F.col(text))).drop(own)
