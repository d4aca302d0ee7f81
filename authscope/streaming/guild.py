"""Streams of guild events: watermarked windows, scored joins, and a ledger over micro-batches.

Each function takes a streaming (or plain) DataFrame of (event_id, guild_id, user_id, ts, ...) and returns one; ``drained`` runs a
stream over what is there now, into Parquet in the shared folder. Bursts by keyed state are in ``sessions``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from authscope.operators import monitor, rules
from authscope.sources.tables import shared_folder

DELAY = "10 minutes"
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def file_stream(spark: SparkSession, sf_dir: str, table: str = "events") -> DataFrame:
    """A table as a stream of its files."""
    return spark.readStream.schema(spark.read.parquet(f"{sf_dir}/{table}.parquet").schema).parquet(f"{sf_dir}/{table}.parque[t]")  # a stream of one file needs a pattern


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of files; event times as timestamps, guilds of ten users."""
    return file_stream(spark, sf_dir).select("event_id", F.floor(F.col("user_id") / 10).alias("guild_id"), "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")


def drained(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """Runs ``stream`` over all input that is there and returns what it has appended to ``folder`` so far.

    A folder that is given again goes on where it stopped: offsets, watermark and keyed state are read from its checkpoint.
    """
    spark = stream.sparkSession
    folder = folder or shared_folder(spark, "stream")
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)  # keyed state with timers asks for it; read when a query begins
    try:
        sink = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True)
        sink.start(f"{folder}/rows").awaitTermination()
    finally:
        spark.conf.set(STORE, before)
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def counts(df: DataFrame, keys: list[str], span: str, slide: str | None = None, least: int = 1) -> DataFrame:
    """(keys, window_start, n) of closed windows with ``least`` events or more; later rows than ``DELAY`` are dropped."""
    seen = df.withWatermark("ts", DELAY).groupBy(*keys, F.window("ts", span, slide)).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return seen.select(*keys, F.unix_seconds("window.start").alias("window_start"), "n")


def scored(df: DataFrame, accounts: DataFrame) -> DataFrame:
    """A sink row for each join and each message burst: suspicion, its reasons and whether to act; only joins are acted upon.

    ``df``: (event_id, guild_id, user_id, ts, join_burst, message_burst); ``accounts``: (user_id, created_at, has_avatar), joined as a
    table. An account that is not there is of no known age and counts as one with an avatar.
    """
    known = df.join(accounts, "user_id", "left")
    age = (F.unix_micros("ts") - F.unix_micros("created_at")) / 86_400_000_000
    flags = known.withColumns({"age_days": age, "has_avatar": F.coalesce("has_avatar", F.lit(1))})
    kind = F.when(F.col("message_burst") == 1, "message").otherwise("join")
    return rules.suspicion(flags).select("event_id", "guild_id", "user_id", kind.alias("kind"), "suspicion", "reasons", F.when(F.col("message_burst") == 1, 0).otherwise(F.col("act")).alias("act"))


CHECKS = "batch long, first_batch long, n long, feature string, psi double, level string"


class DriftLedger:
    """Checks of a stream's values against a table, each time ``every`` rows or more have come in that no check has seen.

    A micro-batch is written under its number. A check covers all batches after the last one checked and is written under the number
    of the batch that filled it; what has been checked is read from the checks before. So a batch that runs twice, also
    after a crash between two writes, counts once and gives one check, and a restart goes on with the rows that wait.
    """

    def __init__(self, spark: SparkSession, folder: str, train: DataFrame, every: int):
        self.spark, self.folder, self.train, self.every = spark, folder, train, every

    def checks(self) -> DataFrame:
        return self.spark.read.schema(CHECKS).option("recursiveFileLookup", True).option("ignoreMissingFiles", True).parquet(self._made("checks"))

    def _made(self, name: str) -> str:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).mkdirs(path)
        return f"{self.folder}/{name}"

    def take(self, batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.folder}/rows/batch={number}")
        checked = self.checks().where(F.col("batch") < number).agg(F.max("batch")).first()[0]
        checked = -1 if checked is None else checked
        waiting = self.spark.read.parquet(f"{self.folder}/rows").where((F.col("batch") > checked) & (F.col("batch") <= number))
        about = waiting.agg(F.count(F.lit(1)).alias("n"), F.min("batch").alias("first")).first()
        if about["n"] >= self.every:
            found = monitor.feature_drift(self.train, waiting.drop("batch"))
            ids = [F.lit(v).cast("long").alias(c) for c, v in (("batch", number), ("first_batch", about["first"]), ("n", about["n"]))]
            found.select(*ids, "feature", "psi", "level").write.mode("overwrite").parquet(f"{self._made('checks')}/{number}")

    def drained(self, stream: DataFrame) -> DataFrame:
        """Takes all input that is there now; returns all checks so far."""
        stream.writeStream.foreachBatch(self.take).option("checkpointLocation", f"{self.folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        return self.checks()
