"""A vector collection on shared storage: changes are appended, reads merge them, and indexes are kept as tables.

Each change is one Parquet folder of rows (vec_id, embedding, gone, seq). A read takes the newest row of each id, so that
writers never rewrite the collection; compact() does, when changes have piled up. One writer at a time.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import shared_path, small_side


@dataclass
class Collection:
    spark: SparkSession
    root: str
    dim: int
    changes: list[str] = field(default_factory=list)

    @classmethod
    def create(cls, spark: SparkSession, name: str, dim: int) -> "Collection":
        return cls(spark, shared_path(spark, f"collection-{name}"), dim)

    @classmethod
    def open(cls, spark: SparkSession, root: str, dim: int) -> "Collection":
        """The collection at root, as far as its changes were written whole."""
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        found = [s.getPath() for s in fs.listStatus(path)] if fs.exists(path) else []
        names = sorted(p.getName() for p in found if p.getName().startswith("change-") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))
        last = max((i for i, n in enumerate(names) if n.endswith("-whole")), default=0)
        return cls(spark, root, dim, [f"{root}/{n}" for n in names[last:]])

    def _add(self, rows: DataFrame, whole: bool = False) -> None:
        n = int(self.changes[-1].rsplit("/change-", 1)[1][:9]) + 1 if self.changes else 0
        path = f"{self.root}/change-{n:09d}{'-whole' if whole else ''}"
        rows.withColumn("seq", F.lit(n).cast("long")).write.mode("overwrite").parquet(path)  # what a failed write left
        self.changes = [path] if whole else [*self.changes, path]

    def upsert(self, vectors: DataFrame) -> None:
        """Add or replace by vec_id; a vector of another length is an error, of repeated ids the greatest vector stays."""
        v = vectors.groupBy("vec_id").agg(F.max("embedding").alias("embedding"))
        v = v.select("vec_id", F.when(F.size("embedding") == self.dim, F.col("embedding")).otherwise(F.raise_error(F.lit("wrong dimension"))).alias("embedding"))
        self._add(v.withColumn("gone", F.lit(False)))

    def insert(self, vectors: DataFrame) -> None:
        """upsert of new ids alone; an id that is there is an error."""
        if not self.contains(vectors).where("present").isEmpty():
            raise ValueError("an id is there already")
        self.upsert(vectors)

    def delete(self, ids: DataFrame) -> None:
        self._add(ids.select("vec_id").distinct().select("vec_id", F.lit(None).cast("array<float>").alias("embedding"), F.lit(True).alias("gone")))

    def all(self) -> DataFrame:
        """vec_id, embedding: the collection as it stands."""
        if not self.changes:
            return self.spark.createDataFrame([], "vec_id long, embedding array<float>")
        rows = self.spark.read.parquet(*self.changes)
        if len(self.changes) == 1:
            return rows.where("NOT gone").select("vec_id", "embedding")
        return rows.groupBy("vec_id").agg(F.max_by(F.struct("embedding", "gone"), "seq").alias("r")).where("NOT r.gone").select("vec_id", "r.embedding")

    def get(self, ids: DataFrame) -> DataFrame:
        return self.all().join(small_side(ids.select("vec_id").distinct()), "vec_id", "left_semi")

    def contains(self, ids: DataFrame) -> DataFrame:
        """vec_id, present for each distinct id asked for."""
        asked = ids.select("vec_id").distinct()
        return asked.join(self.get(ids).select("vec_id", F.lit(True).alias("present")), "vec_id", "left").select("vec_id", F.coalesce("present", F.lit(False)).alias("present"))

    def compact(self) -> None:
        """One change that holds everything; earlier ones are no longer read."""
        if len(self.changes) > 1:
            self._add(self.all().withColumn("gone", F.lit(False)), whole=True)

    def save(self, name: str, index: DataFrame) -> None:
        """Keep an index (centroids, codebook, codes, graphs) beside the vectors."""
        index.write.mode("overwrite").parquet(f"{self.root}/index-{name}")

    def load(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/index-{name}")
