"""Registered queries of whole records: usernames, pasted posts, emoji by range set, class counts, importances in order."""

from __future__ import annotations

from pyspark.sql import functions as F

from authscope.functions import text as T
from authscope.operators import content, language, rules, similarity, training, writing
from authscope.plans.registry import _SCORED, BRANDS, query, scored
from authscope.sources.views import ctes, load

_P, _A, _POSTS = ctes("v_profiles"), ctes("v_accounts"), ctes("v_posts")
# The four sets of emoji ranges, by use.
EMOJI_SETS = {
    "features": T.EMOJI, "bios": writing.BIO_EMOJI, "posts": [(0x1F300, 0x1FFFF), (0x2600, 0x27BF), (0xFE00, 0xFE0F), (0x1F1E0, 0x1F1FF)],
    "pasted": [(0x1F600, 0x1F64F), (0x1F300, 0x1F5FF), (0x1F680, 0x1F6FF), (0x1F1E0, 0x1F1FF), (0x2600, 0x27BF), (0x1F900, 0x1F9FF)],
}
_RANGES = lambda ranges: "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in ranges) + "]"
_N = lambda c, p: f"CAST(len(regexp_extract_all({c}, '{p}')) AS BIGINT)"


@query(f"WITH {_POSTS}, t AS (SELECT post_id, text || CASE post_id % 4 WHEN 0 THEN '😀🀄🥦' WHEN 1 THEN '☀✈️🇩🇪' ELSE '' END AS s FROM v_posts) SELECT post_id, {', '.join(f'{_N("s", _RANGES(r))} AS {n}' for n, r in EMOJI_SETS.items())} FROM t")
def str2_emoji_sets(spark, sf_dir):
    s = F.concat("text", F.when(F.col("post_id") % 4 == 0, "😀🀄🥦").when(F.col("post_id") % 4 == 1, "☀✈️🇩🇪").otherwise(""))
    return load(spark, sf_dir, "v_posts").select("post_id", *[T.emoji_count(s, r).alias(n) for n, r in EMOJI_SETS.items()])


_U = "CASE account_id % 7 WHEN 0 THEN ' ' WHEN 1 THEN 'pаypal' || CAST(account_id AS VARCHAR) ELSE username END"
_LET = "regexp_replace(lower(u), '[^a-z]', '', 'g')"
_B = ", ".join(f"({i}, '{b}')" for i, b in enumerate(BRANDS))
_BOTS = " + ".join(f"CAST(regexp_matches(u, '{p}') AS INT)" for p in T.BOT_NAMES)


@query(f"""WITH {_P}, a AS (SELECT account_id, trim({_U}) AS u FROM v_profiles), s AS (SELECT *, {_LET} AS l, regexp_replace(regexp_replace({_LET}, '[aeiou]', '1', 'g'), '[a-z]', '0', 'g') AS v, u <> '' AS there FROM a), w AS (SELECT list(word) AS ws FROM (SELECT DISTINCT lower(c_mktsegment) AS word FROM customer)),
 b(i, brand) AS (VALUES {_B}), d AS (SELECT account_id, brand, levenshtein(replace(lower(u), 'а', '#'), brand) AS distance, row_number() OVER (PARTITION BY account_id ORDER BY levenshtein(replace(lower(u), 'а', '#'), brand), i) AS r FROM s, b WHERE there), c AS (SELECT account_id, c, count(*) AS n FROM (SELECT account_id, unnest(string_split(u, '')) AS c FROM s WHERE there) GROUP BY ALL), e AS (SELECT account_id, round(-sum(n / z * log2(n / z)), 4) AS h FROM (SELECT *, sum(n) OVER (PARTITION BY account_id) AS z FROM c) GROUP BY account_id),
 p AS (SELECT account_id, list_filter(string_split_regex(lower(u), '[0-9_.\\-]+'), lambda x: length(x) >= 2) AS parts FROM s)
 SELECT s.account_id, CASE WHEN there THEN length(u) END AS uname_length, CASE WHEN there THEN round(len(regexp_extract_all(u, '[0-9]')) / length(u), 4) END AS uname_digit_ratio, CASE WHEN there THEN length(regexp_extract(u, '[0-9]+$')) END AS uname_digit_suffix_length,
 CASE WHEN there THEN round((SELECT max(length(x)) FROM (SELECT unnest(string_split_regex(l, '[aeiou]')) AS x)) / greatest(len(regexp_extract_all(u, '\\p{{L}}')), 1), 4) END AS uname_consonant_cluster_ratio, CASE WHEN there THEN round(len(regexp_extract_all(l, '[aeiou]')) / greatest(len(regexp_extract_all(u, '\\p{{L}}')), 1), 4) END AS uname_vowel_ratio,
 CASE WHEN there THEN CASE WHEN length(v) < 2 THEN 0.5E0 ELSE round(len(list_filter(range(1, length(v)), lambda i: substr(v, CAST(i AS INT), 1) <> substr(v, CAST(i AS INT) + 1, 1))) / (length(v) - 1), 4) END END AS uname_is_pronounceable, CASE WHEN there THEN CAST({_BOTS} AS INT) END AS uname_bot_pattern_count,
 CASE WHEN there THEN {_N('u', '[_.' + chr(92) + '-]')} END AS uname_special_char_count, CASE WHEN there THEN h END AS uname_entropy, CASE WHEN there THEN round(len(list_filter(parts, lambda x: list_contains(ws, x))) / greatest(len(parts), 1), 4) END AS uname_dict_coverage,
 CASE WHEN there THEN {_N('u', '[^' + chr(92) + 'x00-' + chr(92) + 'x7F]')} + {_N('u', '[' + chr(92) + 'p{Cf}' + chr(92) + 'p{Co}]')} END AS uname_homoglyph_count, CAST(distance AS INT) AS uname_brand_distance, brand AS uname_brand_closest
 FROM s LEFT JOIN d ON d.account_id = s.account_id AND r = 1 LEFT JOIN e ON e.account_id = s.account_id LEFT JOIN p ON p.account_id = s.account_id, w""")
def str7_str6_username_record(spark, sf_dir):
    """Thirteen features of a name; NULL for blank ones."""
    u = F.trim(F.expr(_U.replace("VARCHAR", "STRING")))
    rows = load(spark, sf_dir, "v_profiles").select("account_id", u.alias("username"))
    words = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.lower("c_mktsegment").alias("word"))
    there = rows.where("username <> ''")
    u = F.col("username")
    letters = F.regexp_replace(F.lower(u), "[^a-z]", "")
    alpha = F.greatest(T.count(u, r"\p{L}"), F.lit(1))
    own = there.select(
        "account_id", F.length(u).alias("uname_length"), T.share(T.count(u, "[0-9]"), F.length(u)).alias("uname_digit_ratio"), F.length(F.regexp_extract(u, "[0-9]+$", 0)).alias("uname_digit_suffix_length"),
        F.round(F.array_max(F.transform(F.split(letters, "[aeiou]"), lambda x: F.length(x))) / alpha, 4).alias("uname_consonant_cluster_ratio"), F.round(T.count(letters, "[aeiou]") / alpha, 4).alias("uname_vowel_ratio"),
        language.pronounceable(u).alias("uname_is_pronounceable"), sum((T.flag(u, p) for p in T.BOT_NAMES), F.lit(0)).alias("uname_bot_pattern_count"), T.count(u, r"[_.\-]").alias("uname_special_char_count"),
        (T.count(u, r"[^\x00-\x7F]") + T.count(u, r"[\p{Cf}\p{Co}]")).alias("uname_homoglyph_count"),
    )
    parts = [own, content.char_entropy(there, "username").withColumnRenamed("entropy", "uname_entropy"), language.dictionary_coverage(there, words).withColumnRenamed("coverage", "uname_dict_coverage"), similarity.closest(there, BRANDS).withColumnsRenamed({"distance": "uname_brand_distance", "brand": "uname_brand_closest"})]
    out = rows.select("account_id")
    for p in parts:
        out = out.join(p, "account_id", "left")
    return out


@query(f"WITH {_SCORED}, t AS (SELECT platform, CASE WHEN confidence < 70 THEN 'Uncertain' ELSE prediction END AS prediction FROM scored) SELECT platform, count(*) FILTER (prediction = 'Fake') AS n_fake, count(*) FILTER (prediction = 'Legit') AS n_legit, count(*) FILTER (prediction = 'Uncertain') AS n_uncertain FROM t GROUP BY platform")
def agg1_counts(spark, sf_dir):
    """Counts of both classes and of uncertain rows, 0 where there are none."""
    rows = rules.user_threshold(scored(spark, sf_dir), 70.0)
    return rows.groupBy("platform").agg(*[F.count_if(F.col("prediction") == p).alias(f"n_{p.lower()}") for p in ("Fake", "Legit", "Uncertain")])


@query("WITH s AS (SELECT CASE WHEN (c_custkey * 7919) % 1000 + (c_custkey % 11) * 40 > 600 THEN 1 ELSE 0 END AS y FROM customer), n AS (SELECT y, count(*) AS n FROM s GROUP BY y) SELECT 'before' AS stage, y, n FROM n UNION ALL SELECT 'after', y, CAST(least(n, floor((SELECT sum(n) FROM n) * 0.5E0 * 0.4E0 + 0.5)) AS BIGINT) FROM n")
def agg5_before_and_after(spark, sf_dir):
    """Class counts before and after even quotas."""
    s = load(spark, sf_dir, "v_scores").select("account_id", "y")
    counts = lambda df, stage: df.groupBy("y").agg(F.count(F.lit(1)).alias("n")).select(F.lit(stage).alias("stage"), "y", "n")
    return counts(s, "before").unionByName(counts(training.by_quota(s, "y", {0: 0.5, 1: 0.5}, 0.4), "after"))


@query()
def top1_importances(spark, sf_dir):
    """The twenty most important features, ties by name."""
    from authscope.plans.modelling import FEATURES, _examples

    return training.importances(training.fit(_examples(spark, sf_dir), FEATURES, votes=(0,)), FEATURES, spark).orderBy(F.desc("importance"), "feature").limit(20)
