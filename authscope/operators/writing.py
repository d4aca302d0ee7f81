"""What posts and bios say: vocabulary, sentences, sentiment, topics, records of bios, likeness of posts and of names."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from authscope.functions import text as T
from authscope.operators import language
from authscope.sources import tables

# Word lists and code-point ranges that results depend on.
POSITIVE = ["good", "great", "love", "happy", "excellent", "amazing", "wonderful", "best", "awesome", "fantastic", "beautiful", "positive", "success", "win", "perfect", "nice", "brilliant", "enjoy", "thanks", "thank"]
NEGATIVE = ["bad", "hate", "terrible", "awful", "worst", "horrible", "disgusting", "fail", "failure", "sad", "angry", "disappointed", "ugly", "poor", "wrong", "broken", "false", "spam", "scam", "fake", "fraud"]
TOPICS = {
    "crypto": ["bitcoin", "btc", "eth", "crypto", "nft", "defi", "token", "hodl"], "promo": ["giveaway", "airdrop", "promo", "free", "win", "offer"],
    "politics": ["election", "president", "vote", "democrat", "republican", "government"], "sports": ["football", "soccer", "basketball", "nba", "nfl", "game", "score"],
    "tech": ["code", "software", "python", "javascript", "api", "github", "developer"], "food": ["recipe", "food", "eat", "restaurant", "cook", "delicious"], "travel": ["travel", "trip", "flight", "hotel", "vacation", "country"],
}
BUZZWORDS = ["guru", "ninja", "visionary", "rockstar", "unicorn", "wizard", "evangelist", "thought leader", "growth hacker", "disruptor", "hustler", "maven", "mastermind", "trailblazer", "influencer"]
SHORTENERS = ["bit.ly", "t.co", "goo.gl", "tinyurl.com", "ow.ly", "buff.ly", "dlvr.it", "ift.tt", "fb.me", "youtu.be", "amzn.to", "is.gd", "short.io", "shorturl.at", "rb.gy", "cutt.ly"]
BIO_EMOJI = [(0x1F300, 0x1FAFF), (0x2600, 0x27BF), (0xFE00, 0xFE0F), (0x1F000, 0x1F02F)]
SPAM_URL = r"(?i)https?://|www\.|bit\.ly|tinyurl|t\.co"


#: Posts of an account up to which its words meet in one row.
FEW = 16


def tokens(c: Column) -> Column:
    return T.words(F.lower(c))


def sentiment(words: Column) -> Column:
    """(positive - negative) / (positive + negative) over a text's distinct words; 0 without any."""
    hits = lambda known: F.size(F.array_intersect(words, F.array(*map(F.lit, known))))
    p, n = hits(POSITIVE), hits(NEGATIVE)
    return F.coalesce(F.try_divide(p - n, p + n), F.lit(0.0)).cast("double")


def topic(c: Column) -> Column:
    """The first topic one of whose words stands in a text, else ``other``."""
    low = F.lower(c)
    return F.coalesce(*[F.when(F.rlike(low, F.lit("|".join(words))), name) for name, words in TOPICS.items()], F.lit("other"))


def topic_counts(posts: DataFrame, key: str = "account_id") -> DataFrame:
    return posts.groupBy(key, topic(F.col("text")).alias("topic")).agg(F.count(F.lit(1)).alias("n"))


def content_features(posts: DataFrame, key: str = "account_id") -> DataFrame:
    """Grouped features of posts that are not blank: a row's own counts come first.

    The words of an account of ``FEW`` posts at most meet in one row with its counts, so a text is cut once; those of larger ones are rows of a
    shuffle of their own. Sentences are cut within a post.
    """
    c = F.col("text")
    rows = posts.where(F.rlike(c, F.lit(r"\S"))).withColumn("_w", tokens(c))
    sentences = F.filter(F.split(c, "[.!?]+"), lambda s: F.rlike(s, F.lit(r"\S")))
    rows = rows.select(
        key, "_w", F.size("_w").alias("words"), F.size(sentences).alias("sentences"), F.aggregate(F.transform(sentences, lambda s: F.size(T.words(s))), F.lit(0), lambda a, x: a + x).alias("sentence_words"), sentiment(F.col("_w")).alias("mood"),
        T.emoji_count(c, BIO_EMOJI).alias("emoji"), T.count(c, r"#[\p{L}\p{N}_]+").alias("tags"), T.count(c, r"\p{Lu}").alias("caps"), F.length(c).alias("chars"), T.flag(c, SPAM_URL).alias("url"),
        (F.size(F.filter("_w", lambda w: w.startswith("@"))) > 0.30 * F.size("_w")).cast("int").alias("mentions"),
    )
    sums = [F.count(F.lit(1)).alias("posts"), *[F.sum(x).alias(x) for x in ("words", "sentences", "sentence_words", "emoji", "tags", "caps", "chars")], F.avg("url").alias("url"), F.avg("mentions").alias("mentions"), F.avg("mood").alias("mood"), F.var_pop("mood").alias("mood_var")]
    number = posts.groupBy(key).agg(F.count(F.lit(1)).alias("n"))  # reads no text
    large = tables.settled(number.where(F.col("n") > FEW).select(key))
    many = not large.isEmpty()
    some = rows.join(large, key, "left_anti") if many else rows
    out = some.withColumn("_w", F.array_distinct("_w")).groupBy(key).agg(*sums, F.size(F.array_distinct(F.flatten(F.collect_list("_w")))).cast("long").alias("kinds"))
    if many:
        rows = rows.join(large, key, "left_semi")
        kinds = rows.select(key, F.explode(F.array_distinct("_w")).alias("w")).distinct().groupBy(key).agg(F.count(F.lit(1)).alias("kinds"))
        out = out.unionByName(rows.groupBy(key).agg(*sums).join(kinds, key, "left").withColumn("kinds", F.coalesce("kinds", F.lit(0))))
    share = lambda a, b: F.round(F.col(a) / F.greatest(F.col(b), F.lit(1)), 4)
    return out.select(
        key, share("kinds", "words").alias("vocabulary_richness"), share("sentence_words", "sentences").alias("avg_sentence_length"), F.round("mood", 4).alias("sentiment_mean"), F.round("mood_var", 4).alias("sentiment_variance"), share("emoji", "words").alias("emoji_ratio"),
        share("tags", "words").alias("hashtag_ratio"), share("caps", "chars").alias("caps_ratio"), F.round("url", 4).alias("url_spam_ratio"), F.round("mentions", 4).alias("mention_spam_ratio"),
    )


def repeated_ratio(c: Column) -> Column:
    """Share of characters in runs of three or more of the same."""
    runs = F.regexp_extract_all(c, F.lit(r"(?s)((.)\2{2,})"), F.lit(1))
    return F.aggregate(F.transform(runs, lambda r: F.length(r)), F.lit(0), lambda a, n: a + n) / F.greatest(F.length(c), F.lit(1))


def bio_forensics(c: Column, template: Column) -> dict[str, Column]:
    """Sixteen features of a bio; blank ones have length 0, is_empty 1 and else NULL. ``template`` is the likeness to known templates."""
    s = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", ""))
    n, words = F.length(s), F.size(T.words(s))
    urls = F.regexp_extract_all(s, F.lit(r"(?i)(https?://\S+|www\.\S+)"), F.lit(1))
    short = F.size(F.filter(urls, lambda u: F.rlike(F.lower(u), F.lit("|".join(x.replace(".", r"\.") for x in SHORTENERS)))))
    emoji = T.emoji_count(s, BIO_EMOJI)
    there = lambda x: F.when(s != "", x)
    cols = {
        "word_count": words, "emoji_count": emoji, "emoji_ratio": F.round(emoji / F.greatest(n, F.lit(1)), 4), "url_count": F.size(urls), "shortened_url_count": short, "mention_count": T.count(s, r"@[\p{L}\p{N}_]+"), "hashtag_count": T.count(s, r"#[\p{L}\p{N}_]+"),
        "spam_score": language.spam_score(s), "template_similarity": template, "invisible_char_count": T.count(s, language.INVISIBLE), "phone_present": T.flag(s, T.PHONE), "email_present": T.flag(s, T.EMAIL), "excessive_caps_ratio": language.caps_ratio(s), "repeated_char_ratio": F.round(repeated_ratio(s), 4),
    }
    return {"bio_length": F.length(s)} | {f"bio_{k}": there(v) for k, v in cols.items()} | {"bio_is_empty": (s == "").cast("int")}


def buzzword_share(c: Column) -> Column:
    words = F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    return F.coalesce(F.round(F.try_divide(F.size(F.filter(words, lambda w: w.isin(BUZZWORDS))), F.size(words)), 4), F.lit(0.0))


def codes(texts: list[str], pad: int) -> np.ndarray:
    """Code points of the texts, a row each, padded with ``pad``."""
    out = np.full((len(texts), max(map(len, texts), default=0)), pad, np.int32)
    for i, t in enumerate(texts):
        out[i, : len(t)] = np.frombuffer(t.encode("utf-32-le"), "<i4")
    return out


def in_front(values: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """The marked values of each row first, in order."""
    return np.take_along_axis(values, np.argsort(~marks, axis=1, kind="stable"), axis=1)


def jaro_winkler(left: list[str], right: list[str]) -> np.ndarray:
    """Of each pair; prefix of four, weight 0.1, for strings of a likeness above 0.7. All pairs go through the characters together."""
    a, b = codes(left, -1), codes(right, -2)
    m, n = np.array([len(t) for t in left]), np.array([len(t) for t in right])
    reach = np.maximum(np.maximum(m, n) // 2 - 1, 0)
    mine, taken = np.zeros(a.shape, bool), np.zeros(b.shape, bool)
    for i in range(a.shape[1]):
        for j in range(max(0, i - int(reach.max(initial=0))), min(b.shape[1], i + int(reach.max(initial=0)) + 1)):
            hit = (a[:, i] == b[:, j]) & ~mine[:, i] & ~taken[:, j] & (abs(i - j) <= reach)
            mine[:, i] |= hit
            taken[:, j] |= hit
    same = mine.sum(axis=1)
    width = min(a.shape[1], b.shape[1])
    turned = ((in_front(a, mine)[:, :width] != in_front(b, taken)[:, :width]) & (np.arange(width) < same[:, None])).sum(axis=1) // 2
    count = np.maximum(same, 1)
    jaro = np.where(same > 0, (same / np.maximum(m, 1) + same / np.maximum(n, 1) + (same - turned) / count) / 3, 0.0)
    first = np.cumprod(a[:, : min(4, width)] == b[:, : min(4, width)], axis=1).sum(axis=1) if width else np.zeros(len(left), int)
    out = np.where(jaro > 0.7, jaro + first * 0.1 * (1 - jaro), jaro)
    return np.where((m == 0) & (n == 0), 1.0, out)


@F.pandas_udf(DoubleType())
def name_likeness(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Each different pair of a batch once, pairs of like length together."""
    for a, b in pairs:
        frame = pd.DataFrame({"a": a, "b": b})
        known = frame.dropna().drop_duplicates().reset_index(drop=True)
        size = np.maximum(known["a"].str.len(), known["b"].str.len()) if len(known) else pd.Series([], dtype=int)
        known["likeness"] = 0.0
        for _, part in known.groupby(np.ceil(np.log2(size.to_numpy(float) + 1))) if len(known) else ():
            for at in range(0, len(part), 1000):
                some = part.iloc[at : at + 1000]
                known.loc[some.index, "likeness"] = jaro_winkler(some["a"].tolist(), some["b"].tolist())
        yield frame.merge(known, how="left", on=["a", "b"])["likeness"].astype("float64")


def name_similarity(name: Column, user: Column) -> Column:
    """Jaro-Winkler of two names' letters; 0.5 where one has none."""
    clean = lambda c: F.trim(F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), "[^a-zA-Z ]", " ")))
    a, b = clean(name), clean(user)
    return F.when((a == "") | (b == ""), 0.5).otherwise(F.round(name_likeness(a, b), 4))


def profile_presence(bio: Column, avatar: Column, location: Column, url: Column, name: Column) -> Column:
    """Weighted share of five fields that are there."""
    return F.round(sum(w * F.coalesce(c.cast("int"), F.lit(0)) for w, c in zip((0.30, 0.25, 0.15, 0.15, 0.15), (bio, avatar, location, url, name))), 4)


def word_cosine(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, cosine) of the word counts of two texts, ``left(key, text)`` and ``right(key, text)``; 0 where one has no words."""
    words = lambda df, side: df.select(key, F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_]+"), F.lit(0))).alias("t")).groupBy(key, "t").agg(F.count(F.lit(1)).alias(side))
    both = words(left, "x").join(words(right, "y"), [key, "t"], "full").na.fill(0, ["x", "y"])
    sums = both.groupBy(key).agg(F.sum(F.col("x") * F.col("y")).alias("d"), F.sum(F.col("x") * F.col("x")).alias("a"), F.sum(F.col("y") * F.col("y")).alias("b"))
    return sums.select(key, F.round(F.coalesce(F.try_divide(F.col("d"), F.sqrt(F.col("a") * F.col("b"))), F.lit(0.0)), 4).alias("cosine"))
