"""A keyed store of scores: each addition is a new folder, and a manifest names the folders that are whole."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmark.operators.stats import no_nan

KEYS = ["item_id", "translator", "seg_id"]


@dataclass(frozen=True)
class ScoreStore:
    """Scores of one metric under ``path``, dealt to buckets by their key, so that a few new keys read only their buckets.

    A version is written whole before its name enters the manifest. A writer that is lost leaves a folder that nothing names; the next one
    writes another. Of a key in several versions the last one counts.
    """

    spark: SparkSession
    path: str
    name: str
    buckets: int = 64

    @property
    def _schema(self) -> str:
        return f"item_id string, translator string, seg_id int, {self.name} double"

    @property
    def _folder(self) -> str:
        return f"{self.path}/{self.name}"

    def versions(self) -> list[int]:
        """Numbers of the whole versions: one short row for each addition."""
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self._folder}/manifest")
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return []
        return sorted(r.version for r in self.spark.read.schema("version long").json(f"{self._folder}/manifest/*").collect())

    def bucket(self) -> F.Column:
        return F.pmod(F.xxhash64(F.col("item_id").cast("string"), F.col("translator").cast("string")), F.lit(self.buckets)).cast("int")

    def read(self, versions: list[int] | None = None) -> DataFrame:
        """item_id, translator, seg_id, the score and ``bucket``."""
        found = [self._read(v) for v in (self.versions() if versions is None else versions)]
        if not found:
            return self.spark.createDataFrame([], self._schema + ", bucket int")
        rows = found[0]
        for more in found[1:]:
            rows = rows.unionByName(more)
        if len(found) == 1:
            return rows.drop("version")
        top = rows.groupBy(*KEYS, "bucket").agg(F.max_by(self.name, "version").alias(self.name))
        return top.select(*KEYS, self.name, "bucket")

    def _read(self, version: int) -> DataFrame:
        return self.spark.read.schema(self._schema + ", bucket int").parquet(f"{self._folder}/version={version}").withColumn("version", F.lit(version))

    def missing(self, rows: DataFrame) -> DataFrame:
        """The rows whose keys the store lacks. The scan is pruned to the buckets of ``rows``."""
        asked = rows.withColumn("bucket", self.bucket())
        return asked.join(self.read().select(*KEYS, "bucket"), [*KEYS, "bucket"], "left_anti").select(*rows.columns)

    def add(self, scores: DataFrame) -> int:
        """Writes a version and then names it; NaN is kept as null. Returns its number."""
        version = max(self.versions(), default=0) + 1
        rows = scores.select(F.col("item_id").cast("string").alias("item_id"), "translator", F.col("seg_id").cast("int").alias("seg_id"), no_nan(F.col(self.name)).cast("double").alias(self.name))
        rows = rows.withColumn("bucket", self.bucket())
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self._folder}/version={version}")
        self.spark.createDataFrame([(version,)], "version long").coalesce(1).write.mode("overwrite").json(f"{self._folder}/manifest/{version}")
        return version
