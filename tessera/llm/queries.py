"""The registered queries of this subpackage, each over its whole table with production parameters."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, mpegts, packing, prefixfree, secrets, simhash, toxicity, urlfilter, warc, wordpiece

#: Where the public vocabulary lies; the same path on every machine.
TOKENIZERS = os.environ.get("TESSERA_TOKENIZERS", "")


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    if TOKENIZERS:
        return os.path.join(TOKENIZERS, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    store = warc.write(pages)
    return warc.read(store, captures=warc.find(store, pages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = secrets.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = lambda kind: F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secret_spans", lambda s: s["ord"] < 3)
    return df.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col("secret_spans")).alias("spans"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(_table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op4_prefix_free_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = prefixfree.dedup(_table(spark, sf_dir, "documents"))
    return df.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("begin").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    return toxicity.score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), vocabulary())


def op7_mpeg_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpegts.describe(_table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return df.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.counts(_table(spark, sf_dir, "documents"), vocabulary())


QUERIES = {f.__name__: f for f in (op1_warc, op2_secret_scan, op3_url_filter, op4_prefix_free_dedup, op5_toxicity, op6_packing, op7_mpeg_ts, op8_simhash, op9_decontamination, op10_token_counts)}


def _base32(hexa: str) -> str:
    part = lambda i: f"lpad(to_base(('0x' || substr({hexa}, {i}, 10))::BIGINT, 32), 8, '0')"
    return f"translate({' || '.join(part(i) for i in (1, 11, 21, 31))}, '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')"


def _url_sql() -> str:
    w, bias = urlfilter.fit()
    rules = sorted(urlfilter.RULES, key=lambda r: (-len(r[0]), r[0]))
    fits = lambda r: f"((host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}'))"
    rule = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r}'" for r, _ in rules) + " END"
    said = "CASE " + " ".join(f"WHEN rule = '{r}' THEN '{v}'" for r, v in rules) + " END"
    gram = lambda s: f"coalesce(list_sum(list_transform(range(1, greatest(length({s}) - 1, 1)), lambda i: w[((ord(substr({s}, i, 1))::BIGINT * 961 + ord(substr({s}, i + 1, 1)) * 31 + ord(substr({s}, i + 2, 1))) % {urlfilter.BUCKETS} + 1)::INT])), 0.0)"
    return f"""
WITH model AS (SELECT [{','.join(f'{v:g}' for v in w)}]::DOUBLE[] AS w),
cut AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
ruled AS (SELECT *, {rule} AS rule, '^' || host || '$' AS h FROM parts),
scored AS (SELECT page_id, host, path, rule, ({gram('h')} + {gram('path')}) / greatest(length(host) + greatest(length(path) - 2, 0), 1) + ({bias}) AS raw FROM ruled, model)
SELECT page_id, host, path, rule, coalesce({said}, CASE WHEN raw >= 0 THEN 'block' ELSE 'allow' END) AS verdict FROM scored"""


def _either(s: str) -> str:
    """A pattern of s in either case of its ASCII letters."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in s)


def _secrets_sql():
    """Spans from gaps and matches; each window's entropy counted afresh."""
    names = "|".join(_either(x) for x in ("password", "passwd", "secret", "token")) + "|" + _either("api") + "_?" + _either("key")
    quote = """["'']?"""
    pats = (("assign", rf"({names}){quote}\x20*[:=]\x20*{quote}([A-Za-z0-9+/_.=-]+)", 6, 2), ("access", "AKIA[A-Z0-9]+", 20, 0), ("hex", "[0-9a-f]+", 24, 0), ("entropy_text", "[A-Za-z0-9+/_-]{20,}", 20, 0))
    found = " UNION ALL ".join(f"""
SELECT rid, {i} AS ord, '{kind}' AS kind, (sum(length(g)) OVER w + coalesce(sum(length(m)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start, m AS piece, v
FROM (SELECT rid, unnest(range(len(ms))) AS i, unnest(ms) AS m, unnest(vs) AS v, unnest(gs[1:len(ms)]) AS g
      FROM (SELECT rid, regexp_extract_all(s, '{p}', 0) AS ms, regexp_extract_all(s, '{p}', {group}) AS vs, string_split_regex(s, '{p}') AS gs FROM t))
WINDOW w AS (PARTITION BY rid ORDER BY i) QUALIFY length(v) >= {least}""" for i, (kind, p, least, group) in enumerate(pats))
    bits = f"list_max(list_transform(range(1, greatest(length(piece) - {secrets.WINDOW - 1}, 1) + 1), lambda i: list_entropy(string_split(substr(piece, i, {secrets.WINDOW}), ''))))"
    return f"""
WITH t AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS s FROM documents),
found AS ({found}),
spans AS (SELECT *, start + length(piece) AS stop FROM found),
free AS (SELECT c.*, regexp_matches(piece, '^[0-9A-Fa-f-]+$') AS isx FROM spans c WHERE ord = 3 AND regexp_matches(piece, '[0-9]') AND NOT regexp_matches(piece, '{secrets.ALLOW}')
         AND NOT EXISTS (SELECT 1 FROM spans b WHERE b.ord < 3 AND b.rid = c.rid AND b.start <= c.start AND b.stop >= c.stop)),
every AS (SELECT rid, ord, kind, start, stop FROM spans WHERE ord < 3
          UNION ALL SELECT rid, 4 - isx::INT, CASE WHEN isx THEN 'entropy_hex' ELSE 'entropy_text' END, start, stop FROM free
          WHERE {bits} >= CASE WHEN isx THEN {secrets.BITS['entropy_hex']} ELSE {secrets.BITS['entropy_text']} END),
lines AS (SELECT rid, count(*) FILTER (ord = 0) AS a, count(*) FILTER (ord = 1) AS k, count(*) FILTER (ord = 2) AS x,
          string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) FILTER (ord < 3) AS base, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) AS spans FROM every GROUP BY rid)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(k, 0)::BIGINT AS n_access, coalesce(x, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN lines USING (rid)"""


_WORDS_SQL = r"regexp_extract_all(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE = {
    "op1_warc": f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h FROM p),
k AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS keeper FROM d)
SELECT page_id, n::BIGINT AS payload_bytes, {_base32('h')} AS payload_digest,
       CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = keeper THEN NULL ELSE keeper END AS refers_to FROM k""",
    "op2_secret_scan": _secrets_sql(),
    "op3_url_filter": _url_sql(),
    "op4_prefix_free_dedup": f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS b FROM documents),
starts AS (SELECT rid, doc_id, p, b[p + 1 : p + {prefixfree.WIDTH}] AS s FROM (SELECT *, unnest(range(octet_length(b) - {prefixfree.WIDTH - 1})) AS p FROM d)),
least AS (SELECT rid, p, min(doc_id) OVER (PARTITION BY s) < doc_id AS gone FROM starts),
fresh AS (SELECT rid, p, coalesce(p > lag(p) OVER w + {prefixfree.WIDTH}, true)::INT AS f FROM least WHERE gone WINDOW w AS (PARTITION BY rid ORDER BY p)),
runs AS (SELECT rid, min(p) AS a, max(p) + {prefixfree.WIDTH} AS z FROM (SELECT rid, p, sum(f) OVER (PARTITION BY rid ORDER BY p) AS k FROM fresh) GROUP BY rid, k),
gaps AS (SELECT rid, coalesce(lag(z) OVER (PARTITION BY rid ORDER BY a), 0) AS x, a AS y FROM runs
         UNION ALL SELECT rid, max(z), octet_length(any_value(b)) FROM runs JOIN d USING (rid) GROUP BY rid),
kept AS (SELECT rid, string_agg(CASE WHEN y > x THEN hex(b[x + 1 : y]) ELSE '' END, '' ORDER BY x) AS h FROM gaps JOIN d USING (rid) GROUP BY rid),
sums AS (SELECT rid, sum(z - a) AS removed, count(*) AS n FROM runs GROUP BY rid)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans, sha256(CASE WHEN h IS NULL THEN b ELSE unhex(h) END) AS kept_sha256
FROM d LEFT JOIN sums USING (rid) LEFT JOIN kept USING (rid)""",
    "op9_decontamination": f"""
WITH d AS (SELECT doc_id, {_WORDS_SQL.format(t="coalesce(text, '')")} AS w FROM documents),
b AS (SELECT item_id, {_WORDS_SQL.format(t="coalesce(text, '')")} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS s
        FROM (SELECT item_id, w, least(len(w), {decontaminate.WINDOW}) AS n, unnest(range(1, greatest(len(w) - {decontaminate.WINDOW - 1}, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
starts AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n),
found AS (SELECT doc_id, i, x.n, item_id FROM (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS s FROM starts) x JOIN win USING (n, s)),
spots AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS k FROM found) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN spots USING (doc_id) LEFT JOIN items USING (doc_id)""",
}
