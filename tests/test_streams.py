"""Keyed state and the drift ledger against brute force: order within the delay, late rows, restarts, repeated batches."""

import random

import pytest
from pyspark.sql import functions as F

from authscope.operators import monitor
from authscope.streaming import guild, sessions

ROWS = "event_id long, guild_id long, user_id long, t long, event_type string"
START = 1_700_000_000


class Feed:
    """A folder of files that a stream reads, and the folder that the stream goes on from."""

    def __init__(self, spark, tmp_path):
        self.spark, self.path = spark, str(tmp_path / "in")
        self.to = str(tmp_path / "out")

    def add(self, rows):
        df = self.spark.createDataFrame(rows, ROWS)
        df.withColumn("ts", F.timestamp_seconds("t")).drop("t").coalesce(1).write.mode("append").parquet(self.path)

    def stream(self):
        return self.spark.readStream.schema("event_id long, guild_id long, user_id long, event_type string, ts timestamp").parquet(self.path)


def trailing(rows, span, until):
    joins = [r for r in rows if r[4] == "signup"]
    return sorted((r[0], r[1], sum(o[1] == r[1] and r[3] - span <= o[3] <= r[3] for o in joins)) for r in joins if r[3] <= until)


def test_trailing_counts_of_shuffled_parts(spark, tmp_path):
    """Two arrivals, the second with rows older than some of the first (within the delay), with one that is too late, and after a stop."""
    r, feed = random.Random(1), Feed(spark, tmp_path)
    rows = [(i, r.randrange(3), i, START + r.randrange(4000), "signup") for i in range(200)]
    first, second = [x for x in rows if x[3] < START + 2000], [x for x in rows if x[3] >= START + 2000]
    moved = [x for x in first if x[3] > max(y[3] for y in first) - 300][::2]
    first = [x for x in first if x not in moved]
    late = (999, 0, 999, min(x[3] for x in rows) + 5, "signup")
    counted = lambda: sessions.trailing_counts(feed.stream(), ["guild_id"], 120, also=("user_id",))
    feed.add(first)
    got = guild.drained(counted(), feed.to)
    until = max(x[3] for x in first) - 600
    assert sorted((x.event_id, x.guild_id, x.n) for x in got.collect()) == trailing(first, 120, until - 1)  # what came in so far is answered as far as the watermark
    feed.add([*moved, *second, late])
    got = guild.drained(counted(), feed.to)
    until = max(x[3] for x in rows) - 600
    assert sorted((x.event_id, x.guild_id, x.n) for x in got.collect()) == trailing(rows, 120, until - 1)
    assert all(x.user_id == x.event_id for x in got.collect())


def first_bursts(rows, span, least, within, until):
    found, told = [], set()
    for m in sorted((r for r in rows if r[4] != "signup" and r[3] <= until), key=lambda r: (r[3], r[0])):
        same = [o for o in rows if o[1:3] == m[1:3]]
        joins = sorted((o[3], o[0]) for o in same if o[4] == "signup" and o[3] <= m[3])
        n = sum(o[4] != "signup" and m[3] - span <= o[3] <= m[3] for o in same)
        if joins and m[3] - joins[-1][0] <= within and n >= least and joins[-1] not in told:
            told.add(joins[-1])
            found.append((m[0], joins[-1][1], m[1], m[2], n))
    return sorted(found)


def test_message_bursts_once_a_session(spark, tmp_path):
    """One answer a join though the burst goes on, also over a restart; a join anew opens a session; after ``within`` there is none."""
    feed, new = Feed(spark, tmp_path), iter(range(10_000))
    say = lambda user, at, kind="view": (next(new), 1, user, START + at, kind)
    rows = [say(1, 0, "signup"), *(say(1, 10 + i) for i in range(20)), say(1, 2000, "signup"), *(say(1, 2010 + 5 * i) for i in range(12))]
    rows += [say(2, 0, "signup"), *(say(2, 901 + i) for i in range(20))]  # too long after the join
    rows += [say(3, -5 + i) for i in range(5)] + [say(3, 0, "signup"), *(say(3, 1 + i) for i in range(4))]  # messages before the join count
    rows += [say(4, 3 * i) for i in range(30)]  # never joined
    rows += [say(5, 0, "signup"), *(say(5, 8) for _ in range(8))]  # all at one time
    r = random.Random(2)
    for user in range(10, 25):
        rows += [say(user, r.randrange(3000), r.choice(["signup", "view", "view", "view"])) for _ in range(60)]
    rows += [say(99, 9000)]  # moves the watermark beyond all of them
    bursts = lambda: sessions.message_bursts(feed.stream(), ["guild_id", "user_id"], 60, 8, 900, F.col("event_type") != "signup")
    key = lambda df: sorted((x.event_id, x.join_id, x.guild_id, x.user_id, x.n) for x in df.collect())
    early = [x for x in rows if x[3] < START + 15]
    feed.add(early)
    guild.drained(bursts(), feed.to)
    feed.add([x for x in rows if x not in early])
    got = key(guild.drained(bursts(), feed.to))
    want = first_bursts(rows, 60, 8, 900, START + 9000 - 601)
    assert got == want and {g[3] for g in got} >= {1, 3, 5} and not {g[3] for g in got} & {2, 4} and sum(g[3] == 1 for g in got) == 2


@pytest.fixture
def train(spark):
    return spark.range(400).select((F.col("id") % 50).cast("double").alias("value"))


def test_ledger_checks_when_enough_have_come(spark, tmp_path, train):
    """Files of 30 rows: a check each time 100 wait, over them all; also over a stop between any two files, and with no row lost."""
    ledger, feed = guild.DriftLedger(spark, str(tmp_path), train, 100), str(tmp_path / "in")
    values = [[float((7 * i * k + i) % 90) for i in range(30)] for k in range(10)]
    for k, v in enumerate(values):
        spark.createDataFrame([(x,) for x in v], "value double").coalesce(1).write.mode("append").parquet(feed)
        got = ledger.drained(spark.readStream.schema("value double").parquet(feed))
        assert {(r.batch, r.first_batch, r.n) for r in got.collect()} == {(b, b - 3, 120) for b in (3, 7) if b <= k}
    for r in got.collect():
        recent = spark.createDataFrame([(x,) for v in values[r.first_batch : r.batch + 1] for x in v], "value double")
        assert r.psi == monitor.feature_drift(train, recent).first().psi


def test_ledger_batch_that_runs_twice(spark, tmp_path, train):
    """A crash after the rows are written, or after the check is: the batch comes again and counts once."""
    ledger = guild.DriftLedger(spark, str(tmp_path), train, 100)
    batch = lambda k: spark.range(60).select((F.col("id") + k).cast("double").alias("value"))
    ledger.take(batch(0), 0)
    ledger.take(batch(0), 0)
    assert ledger.checks().count() == 0
    for _ in range(2):
        ledger.take(batch(1), 1)
        assert [(r.batch, r.first_batch, r.n) for r in ledger.checks().collect()] == [(1, 0, 120)]
    ledger.take(batch(2), 2)
    ledger.take(batch(3), 3)
    ledger.take(batch(1), 1)  # an old batch again changes nothing
    assert sorted((r.batch, r.first_batch, r.n) for r in ledger.checks().collect()) == [(1, 0, 120), (3, 2, 120)]


def test_scored_rows(spark):
    rows = [(1, 1, 7, 1000, 1, 0), (2, 1, 8, 1000, 0, 1), (3, 1, 9, 1000, 0, 0)]
    df = spark.createDataFrame(rows, "event_id long, guild_id long, user_id long, t long, join_burst int, message_burst int").withColumn("ts", F.timestamp_seconds("t"))
    accounts = spark.createDataFrame([(7, 900, 0), (8, -7 * 86_400 + 1001, 1)], "user_id long, c long, has_avatar int").select("user_id", F.timestamp_seconds("c").alias("created_at"), "has_avatar")
    got = {r.event_id: (r.kind, r.suspicion, r.act) for r in guild.scored(df, accounts).collect()}
    assert got == {1: ("join", 80, 1), 2: ("message", 70, 0), 3: ("join", 0, 0)}
