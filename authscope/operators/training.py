"""Models of pyspark.ml: feature filter, votes and stacks of classifiers, calibrators, balancing, search, anomalies, stability."""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable
from functools import partial, reduce
from multiprocessing.pool import ThreadPool
from typing import Any

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import Imputer, RobustScaler, SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from authscope.operators import calibration, knn, margins, monitor, reports, scaling
from authscope.sources import tables


def redundant(df: DataFrame, features: list[str], most: float = 0.95) -> DataFrame:
    """(feature): those that correlate beyond ``most`` with an earlier one of the list."""
    return reports.correlations(df, features).where(F.abs("r") > most).select(F.col("b").alias("feature")).distinct()


def prepared(features: list[str]) -> list:
    """Medians where values lack, the log step of power-law columns, scaling by the interquartile range."""
    filled, stepped = [f"_{f}" for f in features], [f"_l_{f}" for f in features]
    logs = ", ".join(f"{f'ln(1 + greatest(_{f}, 0D))' if scaling.is_power_law(f) else f'_{f}'} AS _l_{f}" for f in features)
    return [Imputer(inputCols=features, outputCols=filled, strategy="median"), SQLTransformer(statement=f"SELECT *, {logs} FROM __THIS__"), VectorAssembler(inputCols=stepped, outputCol="_raw"), RobustScaler(inputCol="_raw", outputCol="_x", withCentering=True)]


VOTERS = 4


def voters(seed: int = 42) -> list:
    kinds = [RandomForestClassifier(numTrees=30, maxDepth=8, seed=seed), GBTClassifier(maxIter=10, seed=seed), LogisticRegression(maxIter=30)]
    named = [m.setFeaturesCol("_x").setLabelCol("y").setWeightCol("weight") for m in kinds]
    return [m.setPredictionCol(f"_p{k}").setRawPredictionCol(f"_r{k}").setProbabilityCol(f"_q{k}") for k, m in enumerate(named)] + [margins.KernelMargin(out="_q3", seed=seed)]


#: Folds that are fitted at a time.
AT_ONCE = 2


def at_once(spark: SparkSession, jobs: list[Callable[[], Any]], most: int = AT_ONCE) -> list:
    """What ``jobs`` return, ``most`` of them running: a fit is many short passes, which alone leave cores idle."""
    with ThreadPool(min(most, len(jobs))) as pool:
        return pool.map(lambda run: run(), [inheritable_thread_target(spark)(job) for job in jobs], chunksize=1)


def fit(train: DataFrame, features: list[str], seed: int = 42, votes: tuple[int, ...] = (0, 1, 2, 3)):
    """Imputation, log step, scaling and the classifiers ``votes`` on rows of (y, features), classes weighed alike."""
    numbers = tables.settled(train.where("y is not null").select("y", *[F.col(f).cast("double").alias(f) for f in features]))  # ``train`` is made once
    classes = calibration.class_weights(numbers).collect()  # one row a class
    weight = reduce(lambda c, r: F.when(F.col("y") == r["y"], F.lit(r["weight"])).otherwise(c), classes, F.lit(None).cast("double"))
    weighed = numbers.withColumn("weight", weight).coalesce(max(1, sum(r["n"] for r in classes) // margins.ROWS))
    ready = Pipeline(stages=prepared(features)).fit(weighed)
    stages, rows = voters(seed), ready.transform(weighed)
    return PipelineModel([*ready.stages, *at_once(train.sparkSession, [partial(stages[k].fit, rows) for k in votes], VOTERS)])  # no vote reads another


def scored(model, df: DataFrame, features: list[str]) -> DataFrame:
    """Adds raw_proba: the mean of the classifiers' probabilities."""
    out = model.transform(df.withColumns({f: F.col(f).cast("double") for f in features}))
    told = [f"_q{k}" for k in range(VOTERS) if f"_q{k}" in out.columns]
    mean = reduce(lambda a, b: a + b, [vector_to_array(c)[1] for c in told]) / len(told)
    return out.withColumn("raw_proba", mean).select(*df.columns, "raw_proba")


def importances(model, features: list[str], spark) -> DataFrame:
    """(feature, importance, keep): keep those of half the mean, and 0.01, at least. One row a feature of the list."""
    forest = next(m for m in model.stages if isinstance(m, RandomForestClassificationModel))
    found = forest.featureImportances.toArray().tolist()
    least = max(0.5 * sum(found) / len(found), 0.01)
    return spark.createDataFrame(list(zip(features, found)), "feature string, importance double").withColumn("keep", F.col("importance") >= least)


def calibrators(df: DataFrame) -> DataFrame:
    """(method, brier, chosen) of the raw, the temperature, the Platt and the isotonic probabilities of (raw_proba, y).

    The least Brier score wins if it comes below 0.98 of the raw one.
    """
    p = F.least(F.greatest("raw_proba", F.lit(1e-6)), F.lit(1 - 1e-6))
    rows = VectorAssembler(inputCols=["logit"], outputCol="_x").transform(df.select("raw_proba", F.col("y").cast("double").alias("y"), F.log(p / (1 - p)).alias("logit")))
    platt = LogisticRegression(featuresCol="_x", labelCol="y", probabilityCol="_q", rawPredictionCol="_r", predictionCol="_p").fit(rows).transform(rows)
    iso = IsotonicRegression(featuresCol="raw_proba", labelCol="y", predictionCol="_i").fit(rows).transform(platt)
    error = lambda c: F.avg(F.pow(c - F.col("y"), 2))
    row = iso.agg(error(F.col("raw_proba")).alias("raw"), error(vector_to_array("_q")[1]).alias("platt"), error(F.col("_i")).alias("isotonic"))
    best = calibration.temperature(df).agg(F.min("brier").alias("temperature"))
    one = row.join(best).unpivot([], ["raw", "platt", "isotonic", "temperature"], "method", "brier")  # one row each
    lowest, raw = one.agg(F.min("brier").alias("lowest"), F.min(F.when(F.col("method") == "raw", F.col("brier"))).alias("raw")), F.col("raw")
    pick = F.when(F.col("lowest") < 0.98 * raw, F.col("brier") == F.col("lowest")).otherwise(F.col("method") == "raw")
    return one.join(lowest).select("method", F.round("brier", 6).alias("brier"), pick.alias("chosen"))


def hashed(key: str, n: int, seed: int = 42) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(n))


def uniform(*keys) -> Column:
    """A number in [0, 1) that only the keys decide."""
    return F.pmod(F.xxhash64(*keys), F.lit(1 << 40)) / float(1 << 40)


def stacked(train: DataFrame, rows: DataFrame, features: list[str], k: int = 3, key: str = "account_id") -> DataFrame:
    """``rows`` with raw_proba by a logistic model whose inputs are the base classifiers' probabilities; it is fitted on out-of-fold ones."""
    probabilities = lambda model, df: model.transform(df.withColumns({f: F.col(f).cast("double") for f in features})).select(*df.columns, *[vector_to_array(f"_q{i}")[1].alias(f"_b{i}") for i in range(VOTERS)])
    folded = tables.settled(train.withColumn("_fold", hashed(key, k)))
    fits = [partial(fit, folded.where(F.col("_fold") != i).drop("_fold"), features) for i in range(k)] + [partial(fit, folded.drop("_fold"), features)]
    *models, whole = at_once(train.sparkSession, fits)
    out = [probabilities(models[i], folded.where(F.col("_fold") == i)).select("y", *[f"_b{j}" for j in range(VOTERS)]) for i in range(k)]
    told = tables.settled(reduce(DataFrame.unionByName, out))  # scored once; the meta model's passes read what was told
    inputs = VectorAssembler(inputCols=[f"_b{i}" for i in range(VOTERS)], outputCol="_z")
    meta = LogisticRegression(featuresCol="_z", labelCol="y", probabilityCol="_q", rawPredictionCol="_r", predictionCol="_p").fit(inputs.transform(told))
    scored_rows = meta.transform(inputs.transform(probabilities(whole, rows)))
    return scored_rows.withColumn("raw_proba", vector_to_array("_q")[1]).select(*rows.columns, "raw_proba")


def oversampled(df: DataFrame, features: list[str], adaptive: bool, k: int = 5, key: str = "account_id") -> DataFrame:
    """(y, features..., made): all rows, and new ones of the rarer class between a row and one of its ``k`` nearest of that class.

    As many are made as the classes differ by, shared evenly, or (``adaptive``) by how many of a row's nearest of all rows are of the
    other class. The quotas come up to the difference to the row: what is left of a share by rounding goes to the largest remainders.
    """
    sizes = {r["y"]: r["n"] for r in df.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    rare = min(sizes, key=lambda y: (sizes[y], y))
    need = max(sizes.values()) - sizes[rare]
    numbers = df.withColumns({f: F.col(f).cast("double") for f in features})
    placed = tables.settled(placed_rows(numbers, features, key))
    own = placed.where(F.col("y") == rare)
    near = tables.settled(knn.nearest(own, own, k))
    quota = quotas(placed, own, near, need, rare, adaptive, k)
    options = near.groupBy("a").agg(F.array_sort(F.collect_list(F.struct("d", "b"))).alias("o"))  # at most k
    made = quota.where("n > 0").join(options, "a").select("a", "o", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("i"))
    made = made.select("a", F.get("o", F.pmod(F.xxhash64("a", "i"), F.size("o")).cast("int"))["b"].alias("b"), uniform("a", "i", F.lit(2)).alias("t"))
    side = lambda c, p: numbers.select(F.col(key).alias(c), *[F.col(f).alias(f"{p}_{f}") for f in features])
    new = made.join(side("a", "x"), "a").join(side("b", "y"), "b").select(F.lit(rare).alias("y"), *[(F.col(f"x_{f}") + F.col("t") * (F.col(f"y_{f}") - F.col(f"x_{f}"))).alias(f) for f in features], F.lit(True).alias("made"))
    return numbers.select("y", *features, F.lit(False).alias("made")).unionByName(new)


def placed_rows(df: DataFrame, features: list[str], key: str) -> DataFrame:
    """(id, x, y): rows as points, filled, logged and scaled."""
    numbers = df.withColumns({f: F.col(f).cast("double") for f in features})
    return Pipeline(stages=prepared(features)).fit(numbers).transform(numbers).select(F.col(key).cast("long").alias("id"), vector_to_array("_x").alias("x"), "y")


def quotas(placed: DataFrame, own: DataFrame, near: DataFrame, need: int, rare: int, adaptive: bool, k: int) -> DataFrame:
    """(a, share, n): how many new rows each row of the rarer class gives; all of them where no row has neighbours of the other class."""
    rows = near.select("a").distinct()
    if adaptive:
        around = knn.nearest(own, placed, k).join(placed.select(F.col("id").alias("b"), "y"), "b").groupBy("a").agg(F.avg((F.col("y") != rare).cast("int")).alias("w"))
        rows = rows.join(around, "a")
    else:
        rows = rows.withColumn("w", F.lit(1.0))
    rows = tables.settled(rows)
    total = rows.agg(F.sum("w")).first()[0] or 0.0
    shares = tables.settled(rows.select("a", ((F.col("w") if total else F.lit(1.0)) * need / (total or max(rows.count(), 1))).alias("share")).withColumn("_rest", F.round(F.col("share") - F.floor("share"), 12)))
    left = need - (shares.agg(F.sum(F.floor("share"))).first()[0] or 0)
    ranked = tables.numbered(shares.withColumn("_down", -F.col("_rest")), [], ["_down", "a"], "_r")
    return ranked.select("a", "share", (F.floor("share") + (F.col("_r") < left).cast("int")).cast("long").alias("n"))


def out_of_fold(df: DataFrame, features: list[str], most: int = 5, votes: tuple[int, ...] = (0, 2), key: str = "account_id") -> DataFrame:
    """(key, fold, y, raw_proba, pred): every row scored by a vote that is fitted on the other folds.

    Folds are stratified; there are ``most``, or as many as the smaller class has rows. At least two are needed.
    """
    sizes = [r["n"] for r in df.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()]  # a row a class
    k = min(most, *sizes)
    if len(sizes) < 2 or k < 2:
        raise ValueError("two classes of two rows each are needed")
    rows = tables.settled(calibration.folds(df.select(key, "y", *features), k, key))
    models = at_once(df.sparkSession, [partial(fit, rows.where(F.col("fold") != i).drop("fold"), features, votes=votes) for i in range(k)])
    parts = [scored(models[i], rows.where(F.col("fold") == i), features) for i in range(k)]
    return reduce(DataFrame.unionByName, parts).select(key, "fold", "y", "raw_proba", (F.col("raw_proba") >= 0.45).cast("int").alias("pred"))


def fold_metrics(predictions: DataFrame) -> DataFrame:
    """(fold, n, accuracy, precision, recall, f1) of (fold, y, pred); divisions by zero give 0."""
    p, y = F.col("pred") == 1, F.col("y") == 1
    c = predictions.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & y).alias("fn"), F.count_if(p == y).alias("ok"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select("fold", "n", ratio(F.col("ok"), F.col("n")).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def cross_validated(predictions: DataFrame) -> DataFrame:
    """One row: folds, rows, and the means of the folds' metrics to four digits."""
    means = [F.round(F.avg(m), 4).alias(m) for m in ("accuracy", "precision", "recall", "f1")]
    return fold_metrics(predictions).agg(F.count(F.lit(1)).alias("folds"), F.sum("n").alias("rows"), *means)


def retrained(first: DataFrame, corrected: DataFrame, features: list[str], key: str = "account_id"):
    """(model, predictions): a vote fitted anew on the rows of the first training and on reviewed ones, and its out-of-fold predictions.

    Both are (key, label, features...), features that a side lacks NULL. A reviewed row counts beside the row of the same account.
    """
    both = first.withColumn("reviewed", F.lit(0)).unionByName(corrected.withColumn("reviewed", F.lit(1)), allowMissingColumns=True).withColumn("y", F.col("label").cast("int"))
    numbers = [F.col(f).cast("double").alias(f) for f in features]
    rows = tables.settled(both.where("y is not null").select(F.concat_ws(":", F.col(key).cast("string"), F.col("reviewed").cast("string"), F.xxhash64(*[F.col(f) for f in features]).cast("string")).alias("_id"), "y", *numbers))
    return fit(rows, features, votes=(0, 2)), out_of_fold(rows, features, key="_id")


def sampled_forests(n: int, seed: int = 42) -> list[tuple[int, int, int]]:
    """``n`` distinct choices of (trees, depth, least rows of a leaf)."""
    random, out = np.random.default_rng(seed), []
    while len(out) < n:
        one = (int(random.integers(5, 41)), int(random.integers(2, 9)), int(random.integers(1, 21)))
        out += [one] if one not in out else []
    return out


def fold_scores(ready: DataFrame, choices: list[tuple[int, int, int]], k: int) -> list[float]:
    """Mean F1 over ``k`` folds of a forest of each choice, on (_x, y, _fold)."""
    forest = RandomForestClassifier(featuresCol="_x", labelCol="y", seed=42)
    grid = [{forest.numTrees: t, forest.maxDepth: d, forest.minInstancesPerNode: m} for t, d, m in choices]
    found = CrossValidator(estimator=forest, estimatorParamMaps=grid, evaluator=MulticlassClassificationEvaluator(labelCol="y", metricName="f1"), numFolds=k, foldCol="_fold", parallelism=4).fit(ready)
    return [float(m) for m in found.avgMetrics]


def searched(df: DataFrame, features: list[str], k: int = 3, choices: list[tuple[int, int, int]] | None = None, keep: int = 3, key: str = "account_id") -> DataFrame:
    """(round, rows, trees, depth, leaf, f1, stays): successive halving over sampled forests, one row for each that a round tried.

    A round scores what is left on a share of the rows by a hash, the same rows and more in the next; one in ``keep`` stays, the last round
    takes all rows. The row of the last round that stays is the winner.
    """
    rows = df.withColumns({f: F.col(f).cast("double") for f in features})
    ready = Pipeline(stages=prepared(features)).fit(rows).transform(rows).select("_x", "y", hashed(key, k).cast("int").alias("_fold"), uniform(key, F.lit(9)).alias("_at"))
    ready = tables.settled(ready)
    left, log, rounds = choices or sampled_forests(9), [], 0
    while keep**rounds < len(left):
        rounds += 1
    for i in range(rounds + 1):
        some = ready.where(F.col("_at") < 1 / keep ** (rounds - i))
        n = some.count()
        scores = fold_scores(some.drop("_at").coalesce(max(1, n // margins.ROWS)), left, k)
        order = sorted(range(len(left)), key=lambda j: (-scores[j], left[j]))
        stay = set(order[: max(1, -(-len(left) // keep))])
        log += [(i + 1, n, *left[j], scores[j], j in stay) for j in range(len(left))]
        left = [left[j] for j in sorted(stay)]
    return df.sparkSession.createDataFrame(log, "round int, rows long, trees int, depth int, leaf int, f1 double, stays boolean")


SAMPLE, TREES = 256, 50


def grown(rows: np.ndarray, seed: int) -> list[list[float]]:
    """An isolation tree as nodes [feature, split, left, right, depth + expected rest]; feature -1 marks a leaf."""
    rng, nodes = np.random.default_rng(seed), []

    def grow(x: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append([-1.0, 0.0, 0.0, 0.0, depth + expected(len(x))])
        spread = np.flatnonzero(x.max(0) > x.min(0)) if len(x) > 1 else []
        if depth < 8 and len(spread):
            f = int(rng.choice(spread))
            s = rng.uniform(x[:, f].min(), x[:, f].max())
            if 0 < (x[:, f] < s).sum() < len(x):
                nodes[at][:4] = [f, s, grow(x[x[:, f] < s], depth + 1), grow(x[x[:, f] >= s], depth + 1)]
        return at

    grow(rows, 0)
    return nodes


def expected(n: int) -> float:
    """Mean depth of an unsuccessful search among ``n`` rows."""
    return 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else float(n == 2)


def anomalies(df: DataFrame, features: list[str], contamination: float = 0.1, key: str = "account_id") -> DataFrame:
    """(key, score, is_anomaly): isolation forest, higher is stranger. Each tree grows in a group of ``SAMPLE`` rows by a hash; the forest's size is fixed.

    The limit of the flag is an approximate percentile.
    """
    rows = df.select(key, *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features])
    total = max(rows.count(), 1)
    each = F.explode(F.array(*map(F.lit, range(TREES)))).alias("tree")
    chosen = rows.select("*", each).withColumn("_o", uniform(key, "tree")).where(F.col("_o") < 2 * SAMPLE / total)  # about twice the sample, so that few trees lack rows
    chosen = chosen.groupBy("tree").applyInPandas(lambda k, p: pd.DataFrame({"tree": [k[0]], "nodes": [json.dumps(grown(p.sort_values(["_o", key])[features].to_numpy(float)[:SAMPLE], int(k[0])))]}), "tree int, nodes string")
    forest = df.sparkSession.sparkContext.broadcast([np.array(json.loads(r["nodes"])) for r in chosen.orderBy("tree").collect()])  # TREES trees of 511 nodes at most

    def score(batches):
        for p in batches:
            x, depth = p[features].to_numpy(float), np.zeros(len(p))
            for t in forest.value:
                at = np.zeros(len(p), int)
                for _ in range(8):
                    f = t[at, 0].astype(int)
                    inner = f >= 0
                    left = np.where(inner, x[np.arange(len(p)), np.maximum(f, 0)] < t[at, 1], False)
                    at = np.where(inner, np.where(left, t[at, 2], t[at, 3]).astype(int), at)
                depth += t[at, 4]
            yield pd.DataFrame({key: p[key], "score": np.round(100 * 2.0 ** (-depth / max(len(forest.value), 1) / expected(SAMPLE)), 1)})

    out = rows.mapInPandas(score, f"{key} long, score double")
    limit = out.agg(F.percentile_approx("score", 1 - contamination, 10_000).alias("_limit"))
    return out.crossJoin(F.broadcast(limit)).select(key, "score", (F.col("score") > F.col("_limit")).cast("int").alias("is_anomaly"))  # one row


def stability(model, df: DataFrame, features: list[str], rounds: int = 3, share: float = 0.03, key: str = "account_id") -> DataFrame:
    """(key, agreement, stable): how many of ``rounds`` scores with a little noise agree with the plain one."""
    noise = lambda f: (F.sqrt(-2 * F.log(1 - uniform(key, "_round", F.lit(f)))) * F.cos(2 * np.pi * uniform(key, "_round", F.lit(f), F.lit(7)))) * share
    plain = scored(model, df, features).select(key, (F.col("raw_proba") >= 0.45).alias("plain"))
    moved = df.withColumn("_round", F.explode(F.array(*map(F.lit, range(rounds))))).withColumns({f: F.col(f) + F.abs(F.col(f)) * noise(f) for f in features})
    again = scored(model, moved, features).select(key, (F.col("raw_proba") >= 0.45).alias("again")).join(plain, key)
    return again.groupBy(key).agg(F.round(F.avg((F.col("again") == F.col("plain")).cast("int")), 4).alias("agreement")).withColumn("stable", F.col("agreement") >= 0.66)


def history(df: DataFrame, features: list[str], k: int = 5, least: int = 10, key: str = "account_id") -> DataFrame:
    """(platform, rows, accuracy, precision, recall, f1) of a logistic model for each platform, fitted on four fifths of its rows by a hash and measured on the rest."""
    path = tables.shared_folder(df.sparkSession, "platforms")
    df.select("platform", key, "y", *features).write.partitionBy("platform").parquet(path)  # once: a platform's many passes read its own files
    df, out = df.sparkSession.read.schema(df.select("platform", key, "y", *features).schema).parquet(path), []
    for r in df.groupBy("platform").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("y").alias("c")).orderBy("platform").collect():  # a row a platform
        if r["n"] >= least and r["c"] == 2:
            rows = df.where(F.col("platform") == r["platform"]).coalesce(max(1, r["n"] // margins.ROWS)).withColumn("_held", hashed(key, k) == 0)
            numbers = rows.withColumns({f: F.col(f).cast("double") for f in features})
            model = Pipeline(stages=[*prepared(features), LogisticRegression(featuresCol="_x", labelCol="y", predictionCol="_pred")]).fit(numbers.where("not _held"))
            held = model.transform(numbers.where("_held")).select("y", F.col("_pred").cast("int").alias("pred"))
            out.append(monitor.confusion(held).select(F.lit(r["platform"]).alias("platform"), F.lit(r["n"]).alias("rows"), "accuracy", "precision", "recall", "f1"))
    return reduce(lambda a, b: a.unionByName(b), out)


def noisy(df: DataFrame, features: list[str], key: str = "account_id") -> DataFrame:
    """A labelled table with holes, noise and wrong labels, the same at every run: values of 15 % x U(0.5, 1.5) of the rows go, 15 % move by 5 % of the spread, 2 % of labels turn."""
    spread = df.agg(*[F.stddev_samp(f).alias(f"_s_{f}") for f in features])
    out = {}
    for f in features:
        rate = 0.15 * (0.5 + zlib.crc32(f.encode()) % 1000 / 1000)
        gauss = F.sqrt(-2 * F.log(1 - uniform(key, F.lit(f), F.lit(3)))) * F.cos(2 * np.pi * uniform(key, F.lit(f), F.lit(4)))
        moved = F.when(uniform(key, F.lit(f), F.lit(1)) < 0.15, F.greatest(F.lit(0.0), F.col(f) + gauss * 0.05 * F.col(f"_s_{f}"))).otherwise(F.col(f).cast("double"))
        out[f] = moved if f.startswith(("is_", "has_")) else F.when(uniform(key, F.lit(f), F.lit(2)) >= rate, moved)
    turned = F.when(uniform(key, F.lit(5)) < 0.02, 1 - F.col("y")).otherwise(F.col("y"))
    return df.crossJoin(F.broadcast(spread)).withColumns(out | {"y": turned}).select(*df.columns)  # one row


def by_quota(df: DataFrame, by: str, shares: dict, part: float, key: str = "account_id") -> DataFrame:
    """``part`` of the table's number of rows, ``shares`` of them from each value of ``by`` as far as there are any, chosen by a hash of the key."""
    total = df.count()
    quota = F.create_map(*[x for v, s in shares.items() for x in (F.lit(v), F.lit(int(total * part * s + 0.5)))])
    ordered = tables.numbered(df.withColumn("_h", F.xxhash64(key, F.lit(42))), [by], ["_h", key], "_r")
    return ordered.where(F.col("_r") < F.try_element_at(quota, F.col(by))).select(*df.columns)
