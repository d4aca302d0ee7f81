"""Models, sinks and late rows: what SQL cannot express."""

import tempfile

from pyspark.sql import functions as F

from authscope.operators import monitor
from authscope.plans.registry import QUERIES
from authscope.sources import tables
from authscope.streaming import guild

DIR = "/root/testdata/sf0.01"


def test_vote_gives_every_row_a_decision(spark):
    rows = QUERIES["mdl1_mdl11_vote"](spark, DIR)
    assert rows.count() == spark.read.parquet(f"{DIR}/customer.parquet").count()
    assert {r[0] for r in rows.select("prediction").distinct().collect()} <= {"Fake", "Legit"}
    held = rows.where("held_out").withColumn("pred", (F.col("prediction") == "Fake").cast("int"))
    assert 0 <= monitor.confusion(held).first()["accuracy"] <= 1


def test_one_calibrator_is_chosen(spark):
    rows = QUERIES["mdl13_mdl14_calibrators"](spark, DIR).collect()
    assert len(rows) == 4 and sum(r["chosen"] for r in rows) == 1
    brier = {r["method"]: r["brier"] for r in rows}
    assert brier["isotonic"] <= brier["raw"]


def test_missing_columns_and_partitioned_sink(spark):
    c = spark.createDataFrame([("a.csv", "x", ["Followers ", "username"])], "path string, platform string, columns array<string>")
    assert tables.missing_columns(c, {"x": ["username", "followers", "bio"]}).first()["missing"] == ["bio"]
    out = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    tables.write_results(spark.createDataFrame([(1, "x"), (2, "github")], "account_id long, platform string"), out)
    assert spark.read.parquet(out).where("platform = 'x'").count() == 1


def test_late_rows_are_dropped(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    row = "event_id long, guild_id long, ts timestamp"
    times = [["2024-01-01 00:00:00", "2024-01-01 05:00:00"], ["2024-01-01 06:00:00"], ["2024-01-01 00:30:00", "2024-01-01 07:00:00"]]
    for i, ts in enumerate(times):
        spark.createDataFrame([(10 * i + k, 1, t) for k, t in enumerate(ts)], "event_id long, guild_id long, t string").selectExpr("event_id", "guild_id", "cast(t as timestamp) ts").coalesce(1).write.mode("append").parquet(folder)
    files = spark.readStream.schema(row).option("maxFilesPerTrigger", 1).parquet(folder)
    found = {r["window_start"] % 86400 // 3600: r["n"] for r in guild.drained(guild.counts(files, ["guild_id"], "1 hour")).collect()}
    assert found[0] == 1 and found[5] == 1 and 7 not in found  # the row of 00:30 came in the third batch


def test_importances_name_every_feature(spark):
    rows = QUERIES["mdl6_mdl17_importances"](spark, DIR).collect()
    assert len(rows) == 5 and abs(sum(r["importance"] for r in rows) - 1) < 1e-6 and any(r["keep"] for r in rows)


def test_public_figures_stay_legit(spark):
    from authscope.operators import rules

    cases = [(13_000_000, 500, 1200, 1, 4000, 90.0), (2_500_000, 800, 3400, 0, 3650, 85.0), (8_000_000, 200, 4200, 1, 5000, 90.0)]
    rows = spark.createDataFrame([(i, *c, "Fake", 85.0) for i, c in enumerate(cases)], "account_id long, followers long, following long, posts long, is_verified int, account_age_days long, least double, prediction string, confidence double")
    assert all(r["prediction"] == "Legit" and r["confidence"] >= r["least"] for r in rules.public_figure(rows).collect())


def test_stack_and_history(spark):
    n = spark.read.parquet(f"{DIR}/customer.parquet").count()
    rows = QUERIES["mdl2_stacking"](spark, DIR)
    assert rows.count() == n and rows.where("prediction not in ('Fake', 'Legit') or confidence < 50").count() == 0
    found = QUERIES["mdl19_history"](spark, DIR).collect()
    assert len(found) == 10 and all(0 <= r["accuracy"] <= 1 for r in found)


def test_balancing_makes_rows_between_neighbours(spark):
    for name in ("mdl7_smote", "mdl8_adasyn"):
        rows = QUERIES[name](spark, DIR)
        n = {(r["y"], r["made"]): r["count"] for r in rows.groupBy("y", "made").count().collect()}
        old, rare = {y: c for (y, made), c in n.items() if not made}, min((c, y) for (y, made), c in n.items() if not made)[1]
        made = n.get((rare, True), 0)
        assert abs(made - (max(old.values()) - old[rare])) <= 0.2 * max(old.values()) and set(n) == {(0, False), (1, False), (rare, True)}
        ends = rows.where("not made").agg(F.min("followers").alias("a"), F.max("followers").alias("b")).first()
        assert rows.where("made").where((F.col("followers") < ends["a"]) | (F.col("followers") > ends["b"])).count() == 0


def test_anomalies_find_planted_rows(spark):
    from authscope.operators import training

    usual = spark.range(600).selectExpr("id as account_id", "cast(id % 10 as double) as a", "cast(id % 7 as double) as b")
    odd = spark.createDataFrame([(1000 + i, 500.0 + i, -300.0) for i in range(6)], "account_id long, a double, b double")
    rows = training.anomalies(usual.union(odd), ["a", "b"], 0.02).collect()
    assert len(rows) == 606 and all(r["is_anomaly"] == 1 for r in rows if r["account_id"] >= 1000)


def test_noise_and_stability_repeat(spark):
    a, b = (sorted(map(tuple, QUERIES["prj27_noise"](spark, DIR).collect()), key=str) for _ in "ab")
    assert a == b and 0.05 < sum(r[2] is None for r in a) / len(a) < 0.3
    assert QUERIES["mdl18_stability"](spark, DIR).where("agreement < 0 or agreement > 1").count() == 0


def test_drift_of_a_stream_is_checked(spark):
    rows = QUERIES["stm6_incremental_drift"](spark, DIR).collect()
    assert rows and all(r["n"] >= 100 and r["feature"] == "value" for r in rows)


def test_shuffle_repeats(spark):
    a, b = ([r["account_id"] for r in QUERIES["top5_shuffled"](spark, DIR).collect()] for _ in "ab")
    assert a == b != sorted(a)


def test_jaro_winkler():
    import random

    import duckdb

    from authscope.operators.writing import jaro_winkler

    r = random.Random(3)
    pairs = [("martha", "marhta"), ("dwayne", "duane"), ("dixon", "dicksonx"), ("a", "b"), ("ab", "ab"), ("anna smith", "annasmith"), ("x", "xy"), ("jan é", "jané 😀")]
    pairs += [tuple("".join(r.choice("abcd ") for _ in range(r.randrange(1, 14))) for _ in "ab") for _ in range(400)]
    got = jaro_winkler(*map(list, zip(*pairs)))
    assert all(abs(x - duckdb.execute("SELECT jaro_winkler_similarity(?, ?)", list(p)).fetchone()[0]) < 1e-9 for x, p in zip(got, pairs) if all(map(str.isascii, p)))
    assert jaro_winkler(["", "a"], ["", ""]).tolist() == [1.0, 0.0]
