"""Fits of round 3's findings F24, F28 and F30: what a fit reads."""

from pyspark.ml import PipelineModel

from authscope.operators import training


def test_fit_makes_its_rows_once(spark):
    """Class weights and all passes come from the rows as written once; rows without a label are left out."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(len(b))
            yield b

    rows = [(i % 2 if i < 40 else None, float(i % 7 + 20 * (i % 2)), float(i % 5)) for i in range(42)]
    df = spark.createDataFrame(rows, "y int, followers double, posts double").mapInPandas(count, "y int, followers double, posts double")
    model = training.fit(df, ["followers", "posts"], votes=(2,))
    assert made.value == len(rows) and isinstance(model, PipelineModel)
    got = training.scored(model, spark.createDataFrame(rows[:40], "y int, followers double, posts double"), ["followers", "posts"]).collect()
    assert all((r.raw_proba >= 0.5) == (r.y == 1) for r in got)
