"""Training corpus pipeline: toxicity, near-duplicates, benchmark passages, secrets, packing.

Every stage but the last returns the columns of documents (those of COLUMNS that its input has; others are left out). Null and
empty texts pass toxicity, contamination and secrets; of all texts without words the near-duplicate stage keeps one.
Texts of any length are read whole. Rows with a null doc_id pass every filter but their own toxicity. Rows that repeat a
doc_id share its fate, and the near-duplicate stage leaves one of them (the least text). Empty in, empty out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, packing, secrets, simhash, toxicity, wordcopies
from tessera.llm.queries import vocabulary
from tessera.session import small_side, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Rows in an Arrow batch, unless the session sets a number of its own: Spark's 10,000 hold some 35 MB of text, several times over
#: in the worker and in the JVM's direct memory, and neither gives it back while the executor lives.
BATCH_ROWS = 1_000
#: Up to so many ids of documents to drop are sent to all tasks; beyond, documents are joined by shuffle.
IDS = 500_000


def _columns(docs: DataFrame) -> list[str]:
    return [c for c in COLUMNS if c in docs.columns]


def _small_batches(spark: SparkSession) -> None:
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def _same(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["doc_id"]), how)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is 0.3 or more go."""
    _small_batches(spark)
    docs = docs.select(*_columns(docs))
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model, to="__score").where(F.col("__score") < toxicity.THRESHOLD).drop("__score")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays; a group of null ids stays whole.

    Fingerprints (3-word shingles, 2 bits) group exact and almost exact copies; on what they leave, every pair with a
    five-word Jaccard similarity of 0.8 or more loses its larger id.
    """
    _small_batches(spark)
    docs = docs.select(*_columns(docs))
    groups = written(simhash.near_duplicates(docs), "near-groups")
    again = small_side(written(groups.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"), "near-again"), IDS)
    names = [F.min(F.struct("text", *[c for c in docs.columns if c not in ("doc_id", "text")])).alias("row")]
    once = _same(docs, again, "left_semi").groupBy("doc_id").agg(*names).select("doc_id", "row.*").select(*docs.columns)
    kept = groups.where("doc_id = component_id OR component_id IS NULL").select("doc_id").distinct()
    rest = written(_same(groups.select("doc_id").distinct(), kept, "left_anti"), "near-gone")  # fewer than kept: texts need no shuffle
    left = written(_same(_same(docs, again, "left_anti").unionByName(once), small_side(rest, IDS), "left_anti"), "near-left")
    gone = small_side(written(wordcopies.superfluous(left), "near-gone"), IDS)
    return left.join(gone, left["doc_id"] == gone["id"], "left_anti")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    _small_batches(spark)
    docs = docs.select(*_columns(docs))
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _same(docs, small_side(written(found.where("n_hit > 0").select("doc_id").distinct(), "contaminated"), IDS), "left_anti")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in place, and n_chars follows; documents without any stay as they are."""
    _small_batches(spark)
    docs = docs.select(*_columns(docs))
    out = secrets.redact(docs.withColumn("__was", F.col("text")))
    if "n_chars" in docs.columns:
        changed = ~F.col("text").eqNullSafe(F.col("__was"))
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    _small_batches(spark)
    return packing.pack(docs, vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_scans", mask_secrets),
    ("packing", pack_sequences),
]

#: Learned scores, 64-bit text hashes and subword ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs
