"""Decision rules over scored tables, as ordered CASE expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Least confidence in per cent at which a platform keeps "Fake".
LEAST = {"instagram": 60.0, "facebook": 60.0, "x": 60.0, "linkedin": 65.0, "github": 62.0, "youtube": 60.0, "reddit": 58.0, "discord": 65.0, "tiktok": 60.0, "snapchat": 55.0}
CUTOFF = 0.45


def tenths(c: Column) -> Column:
    """Rounded to one decimal by the tenfold value, as the SQL's engine does; by its decimal digits a value just below a tie, as 55.349999999999994, would go down."""
    return F.round(10 * c) / 10


def decided(df: DataFrame, proba: str = "raw_proba") -> DataFrame:
    """prediction and confidence (per cent, the side's probability) from a probability of Fake."""
    p = F.col(proba)
    return df.withColumns({"prediction": F.when(p >= CUTOFF, "Fake").otherwise("Legit"), "confidence": tenths(100 * F.greatest(p, 1 - p))})


def platform_threshold(df: DataFrame) -> DataFrame:
    least = F.coalesce(F.try_element_at(F.create_map(*[x for k, v in LEAST.items() for x in (F.lit(k), F.lit(v))]), F.lower("platform")), F.lit(60.0))
    low = (F.col("prediction") == "Fake") & (F.col("confidence") < least)
    return df.withColumns({"prediction": F.when(low, "Legit").otherwise(F.col("prediction")), "reason": F.when(low, "below_threshold").otherwise("model")})


def user_threshold(df: DataFrame, least: float) -> DataFrame:
    return df.withColumn("prediction", F.when(F.coalesce("confidence", F.lit(0.0)) < least, "Uncertain").otherwise(F.col("prediction")))


def public_figure(df: DataFrame) -> DataFrame:
    """The first rule that holds replaces prediction and confidence."""
    f, g, p, d, v, fake = F.col("followers"), F.col("following"), F.col("posts"), F.col("account_age_days"), F.col("is_verified") == 1, F.col("prediction") == "Fake"
    rules = [(v & (f >= 1_000_000), 97.0), (v & (f >= 100_000) & (d >= 730) & fake & (F.col("confidence") > 60), 92.0), ((f >= 10_000_000) & (p >= 100), 95.0),
             ((f / F.greatest(g, F.lit(1)) >= 1000) & (d >= 1825) & (p >= 50) & fake, 88.0), ((f >= 1_000_000) & (g <= 500) & (d >= 1095) & fake, 90.0)]
    return _first(df, rules, "Legit", "figure_rule")


def bot(df: DataFrame) -> DataFrame:
    f, g, p, d = F.col("followers"), F.col("following"), F.col("posts"), F.col("account_age_days")
    return _first(df, [((d <= 7) & (g >= 1000) & (f <= 50) & (p == 0), 95.0), ((g >= 5000) & (f <= 100) & (p == 0), 93.0)], "Fake", "bot_rule")


def _first(df: DataFrame, rules: list[tuple[Column, float]], label: str, out: str) -> DataFrame:
    number, conf = F.lit(None).cast("int"), F.col("confidence")
    for k, (holds, c) in list(enumerate(rules, 1))[::-1]:
        number, conf = F.when(holds, k).otherwise(number), F.when(holds, c).otherwise(conf)
    return df.withColumns({out: number, "confidence": conf}).withColumn("prediction", F.when(F.col(out).isNotNull(), label).otherwise(F.col("prediction")))


def band(c: Column) -> Column:
    return F.when(c >= 90, "very high").when(c >= 80, "high").when(c >= 65, "medium").when(c >= 50, "low").otherwise("very low")


def merged(df: DataFrame) -> DataFrame:
    """Confidence of two stages: ``s1, s2`` in per cent, ``c1, c2`` completeness."""
    source = F.when(F.col("s1") - F.col("s2") > 15, "stage1_fallback").when(F.col("c2") < 0.7 * F.col("c1"), "stage1_preferred").when(F.col("s2") >= F.col("s1"), "stage2_dominant").otherwise("weighted_merge")
    total = F.greatest(F.col("c1") + F.col("c2"), F.lit(1e-9))
    blend = tenths((F.col("s1") * F.col("c1") + F.col("s2") * F.col("c2")) / total)
    return df.withColumn("source", source).withColumn("confidence", F.when(F.col("source").like("stage1%"), F.col("s1")).when(F.col("source") == "stage2_dominant", F.col("s2")).otherwise(blend))


def suspicion(df: DataFrame) -> DataFrame:
    """Adds suspicion, reasons and act to joins (age_days, has_avatar, join_burst, message_burst)."""
    # Points, limits and names of the reasons.
    signals = [(F.col("age_days") < 7, 40, "new_account<7d"), (F.col("has_avatar") == 0, 15, "no_custom_avatar"), (F.col("join_burst") == 1, 25, "join_burst>5/120s"), (F.col("message_burst") == 1, 30, "message_burst>8/60s")]
    score = sum((F.when(holds, points).otherwise(0) for holds, points, _ in signals), F.lit(0))
    return df.withColumns({"suspicion": score, "reasons": F.concat_ws("|", *[F.when(holds, name) for holds, _, name in signals]), "act": (score >= 70).cast("int")})


def adjusted(df: DataFrame, signals: dict[str, Column]) -> DataFrame:
    """Adds ``shown``: the confidence moved towards a target when the known signals of a legit account agree with the prediction.

    ``signals`` maps a column to a condition on it; NULL columns have no vote.
    """
    legit = F.col("prediction") == "Legit"
    votes = sum((F.col(c).isNotNull().cast("int") for c in signals), F.lit(0))
    agree = sum((F.coalesce((ok == legit).cast("int"), F.lit(0)) for ok in signals.values()), F.lit(0))
    share, c = F.try_divide(agree, votes), F.col("confidence")
    pull = F.when(share >= 0.80, (F.when(legit, 85.0).otherwise(88.0) - c) * 0.45).when(share >= 0.65, (F.when(legit, 75.0).otherwise(78.0) - c) * 0.25).otherwise(0.0)
    moved = c + F.greatest(F.lit(-5.0), F.least(pull, F.lit(12.0)))
    return df.withColumn("shown", F.when(votes == 0, c).otherwise(F.round(F.round(F.least(moved, F.lit(95.0)), 6), 1)))


def safeguarded(df: DataFrame) -> DataFrame:
    """``df`` with figure_rule and bot_rule, which of each set holds first, and what each would decide (p1, c1 and p2, c2): one projection."""
    kept = ["prediction", "confidence"]
    figure = public_figure(df.withColumns({f"_{c}": F.col(c) for c in kept}))
    figure = figure.withColumns({"p1": F.col("prediction"), "c1": F.col("confidence"), "prediction": F.col("_prediction"), "confidence": F.col("_confidence")})
    both = bot(figure)
    return both.withColumns({"p2": F.col("prediction"), "c2": F.col("confidence"), "prediction": F.col("_prediction"), "confidence": F.col("_confidence")}).drop("_prediction", "_confidence")


def precedence(df: DataFrame) -> DataFrame:
    """The allow-list before the public-figure rules before the bot rules: prediction, confidence and which of them held."""
    both, known = safeguarded(df), F.col("listed") == 1
    pick = lambda x, y, z: F.when(known, x).when(F.col("figure_rule").isNotNull(), y).otherwise(z)
    source = F.when(known, "allow_list").when(F.col("figure_rule").isNotNull(), "public_figure").when(F.col("bot_rule").isNotNull(), "bot").otherwise("model")
    return both.select("account_id", "platform", pick(F.lit("Legit"), F.col("p1"), F.col("p2")).alias("prediction"), pick(F.lit(99.0), F.col("c1"), F.col("c2")).alias("confidence"), source.alias("source"))
