"""A table in versions: each write makes a new one, and readers see it once it is whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Versions:
    """Folders 1, 2, ... under ``path``; the greatest that is marked whole is the table.

    The mark is a file that the file system makes in one step after all parts are written, so a write that fails or stops
    half-way leaves the version before as it was, and its leftovers go when that number is written again. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema

    def _fs(self, name: str = ""):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def current(self) -> int:
        """The number of the last whole version, 0 before the first."""
        fs, at = self._fs()
        if not fs.exists(at):
            return 0
        marks = [f.getPath().getName() for f in fs.listStatus(at)]
        return max((int(n.removeprefix("whole-")) for n in marks if n.startswith("whole-")), default=0)

    def read(self, version: int | None = None) -> DataFrame:
        version = self.current() if version is None else version
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{version}") if version else self.spark.createDataFrame([], self.schema)

    def write(self, df: DataFrame) -> int:
        version = self.current() + 1
        df.write.mode("overwrite").parquet(f"{self.path}/{version}")
        fs, mark = self._fs(f"whole-{version}")
        if not fs.createNewFile(mark):
            raise RuntimeError(f"version {version} was written by another")
        return version

    def drop_before(self, version: int) -> None:
        """Deletes older versions, the mark first."""
        for v in range(1, version):
            for name in (f"whole-{v}", str(v)):
                fs, at = self._fs(name)
                fs.delete(at, True)


REGISTRY = "phash long, platform string, profile string, seen_count long, first_seen timestamp, last_seen timestamp"


def register_avatars(registry: Versions, seen: DataFrame) -> int:
    """Merges sightings (phash, platform, profile, seen_at) into a registry: counts rise, the first and last dates widen. Returns the new version.

    Rows of the version before and sightings are summed alike, by one shuffle on the key.
    """
    key = ["phash", "platform", "profile"]
    new = seen.select(*key, F.lit(1).cast("long").alias("seen_count"), F.col("seen_at").alias("first_seen"), F.col("seen_at").alias("last_seen"))
    merged = registry.read().unionByName(new).groupBy(*key).agg(F.sum("seen_count").alias("seen_count"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
    return registry.write(merged)
