"""Registered queries of post, bio and name features, activity rates, platform aggregates and bundles."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from authscope.functions import text as T
from authscope.operators import aggregates, language, nearposts, ngrams, similarity, writing
from authscope.plans.registry import _TRI, ORACLES, QUERIES, TEMPLATES, query
from authscope.sources.views import ctes, load

_P, _A, _POSTS = ctes("v_profiles"), ctes("v_accounts"), ctes("v_posts")
_TOK = lambda c: f"list_filter(string_split_regex(lower({c}), '\\s+'), lambda x: x <> '')"
_N = lambda c, p: f"len(regexp_extract_all({c}, '{p}'))"
_BIO_EMOJI = "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in writing.BIO_EMOJI) + "]"
# The SQL has lists of its own.
_GOOD = "['good', 'great', 'love', 'happy', 'excellent', 'amazing', 'wonderful', 'best', 'awesome', 'fantastic', 'beautiful', 'positive', 'success', 'win', 'perfect', 'nice', 'brilliant', 'enjoy', 'thanks', 'thank']"
_BAD = "['bad', 'hate', 'terrible', 'awful', 'worst', 'horrible', 'disgusting', 'fail', 'failure', 'sad', 'angry', 'disappointed', 'ugly', 'poor', 'wrong', 'broken', 'false', 'spam', 'scam', 'fake', 'fraud']"
_HITS = lambda w, known: f"len(list_intersect({w}, {known}))"
_TOPIC = "CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{'|'.join(ws)}') THEN '{t}'" for t, ws in writing.TOPICS.items()) + " ELSE 'other' END"


@query(f"WITH {_POSTS} SELECT account_id, {_TOPIC} AS topic, count(*) AS n FROM v_posts GROUP BY ALL")
def agg19_topics(spark, sf_dir):
    return writing.topic_counts(load(spark, sf_dir, "v_posts"))


_CONTENT = f"""WITH {_POSTS}, r AS (SELECT account_id, text, {_TOK('text')} AS w, list_filter(string_split_regex(text, '[.!?]+'), lambda s: regexp_matches(s, '\\S')) AS s FROM v_posts WHERE regexp_matches(text, '\\S')),
 c AS (SELECT account_id, w, len(w) AS words, len(s) AS sentences, coalesce(list_sum(list_transform(s, lambda x: {_N('x', chr(92) + 'S+')})), 0) AS sw, {_HITS('w', _GOOD)} AS p, {_HITS('w', _BAD)} AS g, {_N('text', _BIO_EMOJI)} AS emoji, {_N('text', '#[' + chr(92) + 'p{L}' + chr(92) + 'p{N}_]+')} AS tags, {_N('text', chr(92) + 'p{Lu}')} AS caps, length(text) AS chars,
 CAST(regexp_matches(text, '(?i)https?://|www\\.|bit\\.ly|tinyurl|t\\.co') AS INT) AS url, CAST(len(list_filter(w, lambda x: x LIKE '@%')) > 0.30E0 * len(w) AS INT) AS mentions FROM r), m AS (SELECT *, CASE WHEN p + g = 0 THEN 0.0E0 ELSE (p - g) / (p + g) END AS mood FROM c),
 k AS (SELECT account_id, count(DISTINCT x) AS kinds FROM (SELECT account_id, unnest(w) AS x FROM r) GROUP BY account_id)
 SELECT account_id, round(coalesce(max(kinds), 0) / greatest(sum(words), 1), 4) AS vocabulary_richness, round(sum(sw) / greatest(sum(sentences), 1), 4) AS avg_sentence_length, round(avg(mood), 4) AS sentiment_mean, round(var_pop(mood), 4) AS sentiment_variance, round(sum(emoji) / greatest(sum(words), 1), 4) AS emoji_ratio,
 round(sum(tags) / greatest(sum(words), 1), 4) AS hashtag_ratio, round(sum(caps) / greatest(sum(chars), 1), 4) AS caps_ratio, round(avg(url), 4) AS url_spam_ratio, round(avg(mentions), 4) AS mention_spam_ratio FROM m LEFT JOIN k USING (account_id) GROUP BY account_id"""


@query(_CONTENT)
def agg22_agg23_str19_content(spark, sf_dir):
    return writing.content_features(load(spark, sf_dir, "v_posts"))


_SPAM = " + ".join(f"{k} * CAST(contains(lower(s), '{w}') AS INT)" for k, ws in language.SPAM_WORDS.items() for w in ws)
_SHORT = "|".join(x.replace(".", "\\.") for x in writing.SHORTENERS)
_RUNS = "(SELECT coalesce(sum(CASE WHEN n >= 3 THEN n ELSE 0 END), 0) FROM (SELECT count(*) AS n FROM (SELECT i, c, sum(CASE WHEN c = p THEN 0 ELSE 1 END) OVER (ORDER BY i) AS g FROM (SELECT i, ch[i] AS c, CASE WHEN i > 1 THEN ch[i - 1] END AS p FROM range(1, len(ch) + 1) t(i))) GROUP BY g))"
_BEST = f"(SELECT max(len(list_intersect({_TRI('s')}, v)) / (len({_TRI('s')}) + len(v) - len(list_intersect({_TRI('s')}, v)))) FROM (SELECT {_TRI('x')} AS v FROM (VALUES {', '.join(repr((t,)).replace(',)', ')') for t in TEMPLATES)}) b(x)))"
#: Bios of accounts of two platforms for the record of all features: their texts are whole.
_SOME = "platform IN ('github', 'reddit')"


@query(f"""WITH {_A}, a AS (SELECT account_id, regexp_replace(coalesce(CASE WHEN account_id % 4 = 0 THEN headline || ' aaaa!!! @me #tag https://bit.ly/x +49 123 456 7890 a.b@c.de 🔥🔥🔥' ELSE headline END, ''), '^\\s+|\\s+$', '', 'g') AS s FROM v_accounts), t AS (SELECT account_id, s, lower(trim(s)) AS low, string_split(s, '') AS ch FROM a),
 g AS (SELECT account_id, {_TRI('low')} AS tri FROM t), b(x) AS (VALUES {', '.join(repr((t,)).replace(',)', ')') for t in TEMPLATES)}), u AS (SELECT {_TRI('x')} AS v FROM b), z AS (SELECT account_id, round(max(len(list_intersect(tri, v)) / (len(tri) + len(v) - len(list_intersect(tri, v)))), 4) AS best FROM g, u GROUP BY account_id),
 o AS (SELECT account_id, s, best, s <> '' AS there FROM t JOIN z USING (account_id)), q AS (SELECT account_id, coalesce(sum(n) FILTER (n >= 3), 0) AS runs FROM (SELECT account_id, g, count(*) AS n FROM (SELECT account_id, i, sum(CASE WHEN c = p THEN 0 ELSE 1 END) OVER (PARTITION BY account_id ORDER BY i) AS g FROM (SELECT account_id, i, ch[i] AS c, CASE WHEN i > 1 THEN ch[i - 1] END AS p FROM (SELECT account_id, ch, unnest(range(1, len(ch) + 1)) AS i FROM t))) GROUP BY account_id, g) GROUP BY account_id)
 SELECT account_id, length(s) AS bio_length, CASE WHEN there THEN {_N('s', chr(92) + 'S+')} END AS bio_word_count, CASE WHEN there THEN {_N('s', _BIO_EMOJI)} END AS bio_emoji_count, round(CASE WHEN there THEN {_N('s', _BIO_EMOJI)} / greatest(length(s), 1) END, 4) AS bio_emoji_ratio,
 CASE WHEN there THEN {_N('s', '(?i)https?://' + chr(92) + 'S+|www' + chr(92) + '.' + chr(92) + 'S+')} END AS bio_url_count, CASE WHEN there THEN len(list_filter(regexp_extract_all(s, '(?i)https?://\\S+|www\\.\\S+'), lambda x: regexp_matches(lower(x), '{_SHORT}'))) END AS bio_shortened_url_count,
 CASE WHEN there THEN {_N('s', '@[' + chr(92) + 'p{L}' + chr(92) + 'p{N}_]+')} END AS bio_mention_count, CASE WHEN there THEN {_N('s', '#[' + chr(92) + 'p{L}' + chr(92) + 'p{N}_]+')} END AS bio_hashtag_count, CASE WHEN there THEN round(({_SPAM}) / greatest({_N('s', chr(92) + 'S+')}, 1), 4) END AS bio_spam_score, CASE WHEN there THEN best END AS bio_template_similarity,
 CASE WHEN there THEN {_N('s', language.INVISIBLE)} END AS bio_invisible_char_count, CASE WHEN there THEN CAST(regexp_matches(s, '{T.PHONE}') AS INT) END AS bio_phone_present, CASE WHEN there THEN CAST(regexp_matches(s, '{T.EMAIL}') AS INT) END AS bio_email_present,
 CASE WHEN there THEN round({_N('s', chr(92) + 'p{Lu}')} / greatest({_N('s', chr(92) + 'p{L}')}, 1), 4) END AS bio_excessive_caps_ratio, CASE WHEN there THEN round(coalesce(runs, 0) / greatest(length(s), 1), 4) END AS bio_repeated_char_ratio, CAST(NOT there AS INT) AS bio_is_empty FROM o LEFT JOIN q USING (account_id)""")
def str13_str2_str10_win13_bio_record(spark, sf_dir):
    """The record of a short text, here the headline, in part with signs of spam."""
    text = F.expr("case when account_id % 4 = 0 then concat(headline, ' aaaa!!! @me #tag https://bit.ly/x +49 123 456 7890 a.b@c.de 🔥🔥🔥') else headline end")
    rows = load(spark, sf_dir, "v_accounts").select("account_id", text.alias("bio"))
    best = similarity.template_similarity(rows, TEMPLATES).withColumnRenamed("account_id", "_id")
    rows = rows.join(best, rows.account_id == best._id)
    return rows.select("account_id", *[c.alias(n) for n, c in writing.bio_forensics(F.col("bio"), F.col("similarity")).items()])


_CL = lambda c: f"trim(lower(regexp_replace(coalesce({c}, ''), '[^a-zA-Z ]', ' ', 'g')))"


@query(f"WITH {_A}, c AS (SELECT account_id, {_CL('name')} AS a, {_CL('username')} AS b FROM v_accounts) SELECT account_id, CASE WHEN a = '' OR b = '' THEN 0.5E0 ELSE round(jaro_winkler_similarity(a, b), 4) END AS similarity FROM c")
def str16_name_similarity(spark, sf_dir):
    return load(spark, sf_dir, "v_accounts").select("account_id", writing.name_similarity(F.col("name"), F.col("username")).alias("similarity"))


_WC = lambda col, src, side: f"SELECT account_id, t, count(*) AS {side} FROM (SELECT account_id, unnest(regexp_extract_all(lower({col}), '[a-z0-9_]+')) AS t FROM {src}) GROUP BY ALL"


@query(f"WITH {_A}, {_POSTS}, l AS ({_WC('headline', 'v_accounts', 'x')}), r AS ({_WC('text', 'v_posts', 'y')}), c AS (SELECT account_id, coalesce(x, 0) AS x, coalesce(y, 0) AS y FROM l FULL JOIN r USING (account_id, t)) SELECT account_id, round(CASE WHEN sum(x * x) * sum(y * y) > 0 THEN sum(x * y) / sqrt(sum(x * x) * sum(y * y)) ELSE 0 END, 4) AS cosine FROM c GROUP BY account_id")
def str18_word_cosine(spark, sf_dir):
    return writing.word_cosine(load(spark, sf_dir, "v_accounts").select("account_id", F.col("headline").alias("text")), load(spark, sf_dir, "v_posts"), "account_id")


# Rank profiles of character n-grams, learned from thirteen sixteenths of the documents.
def _grams(name: str, key: str, src: str, where: str = "true") -> str:
    """CTEs {name}w: words by key; {name}r: ranks of grams; {name}z: number of words."""
    return f"""{name}w AS (SELECT {key}, w, count(*) AS c FROM (SELECT {key}, unnest(string_split(trim(regexp_replace(lower(text), '[^\\p{{L}}]+', ' ', 'g')), ' ')) AS w FROM {src} WHERE {where}) WHERE w <> '' GROUP BY ALL),
 {name}g AS (SELECT {key}, g, sum(c) AS n FROM (SELECT {key}, c, unnest(flatten(list_transform([1, 2, 3], lambda k: list_transform(range(1, length(w) + 4 - k), lambda i: substr(' ' || w || ' ', CAST(i AS INT), CAST(k AS INT)))))) AS g FROM {name}w) WHERE g <> ' ' GROUP BY ALL),
 {name}r AS (SELECT {key}, g, r FROM (SELECT {key}, g, row_number() OVER (PARTITION BY {key} ORDER BY n DESC, g) AS r FROM {name}g) WHERE r <= 300), {name}z AS (SELECT {key}, sum(c) AS z FROM {name}w GROUP BY {key})"""


def _tags(name: str, key: str) -> str:
    """CTE {name}t: nearest profile and its distance."""
    return f"""{name}m AS (SELECT {key}, lang, count(*) AS n, sum(abs({name}r.r - pr.r)) AS d FROM {name}r JOIN pr USING (g) GROUP BY ALL), {name}a AS (SELECT {key}, count(*) AS a FROM {name}r GROUP BY {key}),
 {name}t AS (SELECT {key}, CASE WHEN z >= 3 THEN lang END AS tag, distance FROM (SELECT {key}, lang, CAST(d + 300 * (a - n) AS BIGINT) AS distance, row_number() OVER (PARTITION BY {key} ORDER BY d + 300 * (a - n), lang) AS o FROM {name}m JOIN {name}a USING ({key})) JOIN {name}z USING ({key}) WHERE o = 1)"""


_HELD = "substr(md5(CAST(doc_id AS VARCHAR)), 1, 1) IN ('0', '1', '2')"


def language_profiles(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return ngrams.profiles(docs.where(~ngrams.held_out(F.col("doc_id"))))


@query(f"""WITH {_P}, {_POSTS}, {_grams('p', 'lang', 'documents', f'lang IS NOT NULL AND NOT {_HELD}')}, b AS (SELECT account_id, coalesce(bio, '') AS text FROM v_profiles), f AS (SELECT account_id, text FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY post_id) AS r FROM v_posts) WHERE r <= 10),
 {_grams('b', 'account_id', 'b')}, {_tags('b', 'account_id')}, {_grams('f', 'account_id', 'f')}, {_tags('f', 'account_id')} SELECT account_id, CASE WHEN bt.tag IS NULL OR ft.tag IS NULL THEN 0.5E0 WHEN bt.tag = ft.tag THEN 1.0E0 ELSE 0.0E0 END AS consistency FROM v_profiles LEFT JOIN bt USING (account_id) LEFT JOIN ft USING (account_id)""")
def str22_language(spark, sf_dir):
    return ngrams.consistency(load(spark, sf_dir, "v_profiles"), load(spark, sf_dir, "v_posts"), language_profiles(spark, sf_dir))


@query(f"WITH {_grams('p', 'lang', 'documents', f'lang IS NOT NULL AND NOT {_HELD}')}, {_grams('d', 'doc_id', 'documents')}, {_tags('d', 'doc_id')} SELECT doc_id, {_HELD} AS held_out, tag, distance FROM dt")
def str22_language_tags(spark, sf_dir):
    """The language of every document by profiles that the held-out ones had no part in."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return ngrams.told(docs.select("doc_id", "text"), language_profiles(spark, sf_dir), ["doc_id"]).withColumn("held_out", ngrams.held_out(F.col("doc_id")))


_HL = "CASE account_id % 3 WHEN 0 THEN 'Growth Guru and Rockstar, ex ninja' WHEN 1 THEN headline END"


@query(f"WITH {_A}, w AS (SELECT account_id, regexp_extract_all(lower(coalesce({_HL}, '')), '[\\p{{L}}\\p{{N}}_]+') AS w FROM v_accounts) SELECT account_id, CASE WHEN len(w) = 0 THEN 0.0E0 ELSE round(len(list_filter(w, lambda x: x IN ({', '.join(map(repr, writing.BUZZWORDS))}))) / len(w), 4) END AS share FROM w")
def str24_buzzwords(spark, sf_dir):
    return load(spark, sf_dir, "v_accounts").select("account_id", writing.buzzword_share(F.coalesce(F.expr(_HL), F.lit(""))).alias("share"))


@query(f"WITH {_A} SELECT account_id, round(0.30E0 * CAST(coalesce(bio, '') <> '' AS INT) + 0.25E0 * has_avatar + 0.15E0 * CAST(account_id % 3 = 0 AS INT) + 0.15E0 * CAST(headline IS NOT NULL AS INT) + 0.15E0 * CAST(name IS NOT NULL AS INT), 4) AS presence FROM v_accounts")
def arr1_presence(spark, sf_dir):
    there = lambda c: F.col(c).isNotNull()
    return load(spark, sf_dir, "v_accounts").select("account_id", writing.profile_presence(F.coalesce("bio", F.lit("")) != "", F.col("has_avatar") == 1, F.col("account_id") % 3 == 0, there("headline"), there("name")).alias("presence"))


# pairs of one account's posts
_WORDSET = lambda shape: f"w AS (SELECT account_id, post_id, t, count(*) AS tf FROM (SELECT account_id, post_id, unnest(regexp_extract_all(lower(text), '{shape}')) AS t FROM v_posts) GROUP BY ALL), num AS (SELECT account_id, count(*) AS n FROM v_posts GROUP BY account_id)"
_RATIO = "SELECT account_id, coalesce(k, 0) AS n_similar, round(CASE WHEN n > 1 THEN coalesce(k, 0) / (n * (n - 1) / 2) ELSE 0 END, 4) AS ratio FROM num LEFT JOIN hit USING (account_id)"


@query(f"WITH {_POSTS}, {_WORDSET('[^' + chr(92) + 'x20' + chr(92) + 'x09-' + chr(92) + 'x0D]+')}, z AS (SELECT account_id, post_id, count(*) AS s FROM w GROUP BY ALL), m AS (SELECT a.account_id, a.post_id AS x, b.post_id AS y, count(*) AS d FROM w a JOIN w b ON a.account_id = b.account_id AND a.t = b.t AND a.post_id < b.post_id GROUP BY ALL), hit AS (SELECT m.account_id, count(*) AS k FROM m JOIN z p ON p.account_id = m.account_id AND p.post_id = x JOIN z q ON q.account_id = m.account_id AND q.post_id = y WHERE round(d / (p.s + q.s - d), 9) > 0.7 GROUP BY m.account_id) {_RATIO}")
def jon12_similar_posts(spark, sf_dir):
    return nearposts.similar_posts(load(spark, sf_dir, "v_posts"), 0.7, False)


@query(f"WITH {_POSTS}, {_WORDSET('[' + chr(92) + 'p{L}' + chr(92) + 'p{N}_]{2,}')}, f AS (SELECT account_id, t, count(*) AS df FROM w GROUP BY ALL), v AS (SELECT w.account_id, post_id, t, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM w JOIN f USING (account_id, t) JOIN num USING (account_id)), z AS (SELECT account_id, post_id, sqrt(sum(w * w)) AS s FROM v GROUP BY ALL), m AS (SELECT a.account_id, a.post_id AS x, b.post_id AS y, sum(a.w * b.w) AS d FROM v a JOIN v b ON a.account_id = b.account_id AND a.t = b.t AND a.post_id < b.post_id GROUP BY ALL), hit AS (SELECT m.account_id, count(*) AS k FROM m JOIN z p ON p.account_id = m.account_id AND p.post_id = x JOIN z q ON q.account_id = m.account_id AND q.post_id = y WHERE round(d / (p.s * q.s), 9) > 0.85 GROUP BY m.account_id) {_RATIO}")
def jon11_duplicate_posts(spark, sf_dir):
    return nearposts.similar_posts(load(spark, sf_dir, "v_posts"), 0.85, True)


_SIM = "sum(n) AS n, " + ", ".join(f"sum(n * ((h >> {b}) & 1)) AS v{b}" for b in range(64))
_FP = " | ".join(f"(CASE WHEN 2 * v{b} > n THEN {1 << b}::UBIGINT ELSE 0::UBIGINT END)" for b in range(64))


@query(f"""WITH RECURSIVE {_POSTS}, c AS (SELECT account_id, post_id, regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}_]+', '', 'g') AS s FROM v_posts), g AS (SELECT account_id, post_id, unnest(list_transform(range(1, greatest(length(s) - 3, 1) + 1), lambda i: substr(s, CAST(i AS INT), 4))) AS r FROM c),
 k AS (SELECT account_id, post_id, r, count(*) AS n FROM g GROUP BY ALL), u AS (SELECT r, ('0x' || right(md5(r), 16))::UBIGINT AS h FROM (SELECT DISTINCT r FROM k)), v AS (SELECT account_id, post_id, {_SIM} FROM k JOIN u USING (r) GROUP BY ALL),
 f AS (SELECT account_id, {_FP} AS fp, row_number() OVER (PARTITION BY account_id ORDER BY post_id) AS i FROM v), w AS (SELECT account_id, 1::BIGINT AS i, [fp] AS leaders FROM f WHERE i = 1
 UNION ALL SELECT w.account_id, f.i, CASE WHEN len(list_filter(leaders, lambda x: bit_count(xor(x, fp)) <= 3)) > 0 THEN leaders ELSE list_append(leaders, fp) END FROM w JOIN f ON f.account_id = w.account_id AND f.i = w.i + 1)
 SELECT account_id, CAST(max(len(leaders)) AS BIGINT) AS clusters FROM w GROUP BY account_id""")
def jon13_post_clusters(spark, sf_dir):
    return nearposts.cluster_counts(load(spark, sf_dir, "v_posts"))


# rates and platform aggregates
_EV = "e AS (SELECT user_id AS account_id, count(*) FILTER (event_type = 'signup') AS follows, count(*) FILTER (event_type = 'error') AS unfollows, count(*) FILTER (event_type = 'click') AS given, count(*) FILTER (event_type = 'purchase') AS received, count(*) FILTER (event_type = 'view') AS replies, count(*) AS posts FROM events GROUP BY user_id)"
_RATES = f"""WITH {_P}, {_EV}, j AS (SELECT e.*, p.account_age_days AS age, greatest(e.posts - e.replies, 1) AS originals FROM e JOIN v_profiles p USING (account_id))
 SELECT account_id, CAST(CASE WHEN age <= 0 THEN follows ELSE round(follows / age, 4) END AS DOUBLE) AS follow_velocity, CAST(CASE WHEN follows <= 0 THEN 0 ELSE round(least(unfollows / follows, 1.0E0), 4) END AS DOUBLE) AS unfollow_rate, CAST(CASE WHEN given <= 0 THEN CASE WHEN received > 0 THEN received ELSE 1 END ELSE round(received / given, 4) END AS DOUBLE) AS engagement_received_vs_given,
 CAST(round(replies / originals, 4) AS DOUBLE) AS reply_to_original_ratio, CAST(CASE WHEN age <= 0 THEN posts ELSE round(posts / age, 4) END AS DOUBLE) AS account_age_vs_activity FROM j"""


def rates(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    kinds = {"follows": "signup", "unfollows": "error", "given": "click", "received": "purchase", "replies": "view"}
    counts = e.groupBy(F.col("user_id").alias("account_id")).agg(*[F.count_if(F.col("event_type") == v).alias(k) for k, v in kinds.items()], F.count(F.lit(1)).alias("posts"))
    return aggregates.rates(counts.join(load(spark, sf_dir, "v_profiles").select("account_id", F.col("account_age_days").alias("age")), "account_id"))


@query(_RATES)
def agg26_rates(spark, sf_dir):
    return rates(spark, sf_dir)


@query("""WITH r AS (SELECT o_custkey AS account_id, CAST(floor(o_totalprice / 1000) AS BIGINT) AS stars, o_orderstatus = 'F' AS fork, o_orderpriority AS lang, o_orderkey % 3 <> 0 AS described FROM orders) SELECT account_id, CAST(sum(stars) AS BIGINT) AS star_received_total, round(count(*) FILTER (fork) / count(*), 4) AS fork_ratio, round(count(*) FILTER (described) / count(*), 4) AS readme_presence_ratio,
 count(DISTINCT lang) AS unique_languages, round(count(DISTINCT lang) / count(*), 4) AS repo_diversity_score, count(*) AS repos FROM r GROUP BY account_id""")
def agg27_repositories(spark, sf_dir):
    """Orders stand for repositories."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("account_id"), F.floor(F.col("o_totalprice") / 1000).alias("stars"), (F.col("o_orderstatus") == "F").alias("fork"), F.col("o_orderpriority").alias("language"), (F.col("o_orderkey") % 3 != 0).alias("described"))
    return aggregates.repositories(o)


@query(f"""WITH {_A}, {_POSTS}, r AS (SELECT p.*, e.ts FROM v_posts p LEFT JOIN events e ON e.event_id = p.post_id), c AS (SELECT account_id, count(*) FILTER (post_id % 3 <> 0) AS comments, count(*) FILTER (post_id % 3 = 0) AS posts, count(DISTINCT lang) AS communities, count(*) FILTER (post_id % 3 <> 0 AND post_id % 5 = 0) AS fought, avg({_N('text', '[^' + chr(92) + 'x20' + chr(92) + 'x09-' + chr(92) + 'x0D]+')}) FILTER (post_id % 3 <> 0) AS words FROM r GROUP BY account_id),
 h AS (SELECT account_id, hour(ts) AS h, count(*) AS n FROM r WHERE ts IS NOT NULL GROUP BY ALL), x AS (SELECT account_id, -sum(p * log2(p)) AS entropy FROM (SELECT account_id, n / sum(n) OVER (PARTITION BY account_id) AS p FROM h) GROUP BY account_id)
 SELECT account_id, round((comment_karma + post_karma) / greatest(account_age_days, 1), 4) AS karma_per_day, round(comments / greatest(c.posts, 1), 4) AS comment_to_post_ratio, round(communities / (greatest(comments, 1) + greatest(c.posts, 1)), 4) AS subreddit_diversity, round(coalesce(words, 0), 4) AS avg_comment_length, round(fought / greatest(comments, 1), 4) AS controversial_ratio, abs(round(coalesce(entropy, 0), 4)) AS posting_time_entropy,
 round((comment_karma + post_karma) / (greatest(comments, 1) + greatest(c.posts, 1)), 4) AS karma_to_activity_ratio FROM c JOIN v_accounts USING (account_id) LEFT JOIN x USING (account_id)""")
def agg29_comments(spark, sf_dir):
    """Posts as comments and posts; their times are those of the events of the same ids."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("post_id"), F.col("ts").cast("timestamp").alias("ts"))
    rows = load(spark, sf_dir, "v_posts").join(e, "post_id", "left").select("account_id", (F.col("post_id") % 3 != 0).alias("is_comment"), F.col("lang").alias("community"), (F.col("post_id") % 5 == 0).alias("fought"), "text", "ts")
    return aggregates.comments(rows, load(spark, sf_dir, "v_accounts").select("account_id", (F.col("comment_karma") + F.col("post_karma")).alias("karma"), "account_age_days"))


_REF = "CASE post_id % 4 WHEN 0 THEN 'retweeted' WHEN 1 THEN 'replied_to' WHEN 2 THEN 'quoted' END"


@query(f"""WITH {_A}, {_POSTS}, t AS (SELECT account_id, text, {_REF} AS ref FROM v_posts), g AS (SELECT account_id, round(avg(CAST(coalesce(ref = 'retweeted', false) AS INT)), 4) AS retweet_ratio, round(avg(CAST(coalesce(ref = 'replied_to', false) AS INT)), 4) AS reply_ratio, round(avg(length(text)), 4) AS avg_tweet_length, round(avg({_N('text', '#[' + chr(92) + 'p{L}' + chr(92) + 'p{N}_]+')}), 4) AS hashtag_density,
 round(avg({_N('text', '@[' + chr(92) + 'p{L}' + chr(92) + 'p{N}_]+')}), 4) AS mention_density, round(avg(CAST(regexp_matches(text, 'https?://|www\\.') AS INT)), 4) AS url_in_tweet_ratio FROM t GROUP BY account_id) SELECT g.*, round(listed_count / greatest(followers, 1), 4) AS listed_ratio, round(coalesce(tweets, 0) / greatest(account_age_days, 1), 4) AS tweet_frequency, default_profile_image AS default_avatar FROM g JOIN v_accounts USING (account_id)""")
def agg30_str21_tweets(spark, sf_dir):
    """Posts refer to others by a type: repeats and replies are told by any of them."""
    refs = F.when(F.expr(_REF).isNotNull(), F.array(F.struct(F.lit("other").alias("type")), F.struct(F.expr(_REF).alias("type")))).otherwise(F.array().cast("array<struct<type:string>>"))
    return aggregates.tweets(load(spark, sf_dir, "v_posts").select("account_id", "text", refs.alias("referenced")), load(spark, sf_dir, "v_accounts"))


@query(f"""WITH {_A}, o AS (SELECT o_custkey AS account_id, o_orderkey, year(o_orderdate) AS s, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE year(o_orderdate) - o_orderkey % 3 END AS e, lead(year(o_orderdate)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders), c AS (SELECT account_id, count(*) AS positions, count(*) FILTER (coalesce(e, 9999) < n - 1) AS bad FROM o GROUP BY account_id)
 SELECT account_id, CASE WHEN connections >= 500 THEN 3 WHEN connections >= 150 THEN 2 WHEN connections >= 50 THEN 1 ELSE 0 END AS connection_bucket, round(endorsements / greatest(unique_languages, 1), 4) AS endorsement_to_skill_ratio, round((CAST(headline IS NOT NULL AS INT) + CAST(coalesce(about, '') <> '' AS INT) + CAST(coalesce(positions, 0) > 0 AS INT) + CAST(account_id % 2 = 0 AS INT) + CAST(unique_languages > 0 AS INT) + coalesce(profile_pic, 0)) / 6, 4) AS section_completeness,
 round(CASE WHEN coalesce(positions, 0) < 2 THEN 1.0E0 ELSE greatest(0, 1 - bad / (positions - 1)) END, 4) AS career_consistency FROM v_accounts LEFT JOIN c USING (account_id)""")
def agg32_careers(spark, sf_dir):
    """Orders stand for positions: their year is the start, and a position ends in a year or is open."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    year = F.year("o_orderdate")
    positions = o.select(F.col("o_custkey").alias("account_id"), F.col("o_orderdate").alias("place"), F.col("o_orderkey").alias("tie"), year.alias("start_year"), F.when(F.col("o_orderkey") % 4 != 0, year - F.col("o_orderkey") % 3).alias("end_year"))
    people = load(spark, sf_dir, "v_accounts").select("account_id", "connections", "endorsements", F.col("unique_languages").alias("skills"), "headline", "about", (F.col("account_id") % 2).alias("_odd"), F.coalesce("profile_pic", F.lit(0)).alias("has_photo")).withColumn("education", 1 - F.col("_odd"))
    return aggregates.careers(people, positions)


@query(f"""WITH {_A} SELECT account_id, round(followers / greatest(following, 1), 4) AS follower_following_ratio, round(likes / greatest(followers, 1), 4) AS likes_to_follower_ratio, round(likes / greatest(coalesce(videos, 0), 1), 4) AS avg_likes_per_video, round(posts / greatest(followers, 1), 4) AS media_per_follower,
 round((CAST(coalesce(bio, '') <> '' AS INT) + coalesce(profile_pic, 0) + CAST(account_id % 5 = 0 AS INT) + is_verified) / 4, 4) AS profile_completeness FROM v_accounts""")
def agg33_profile_ratios(spark, sf_dir):
    return aggregates.profile_ratios(load(spark, sf_dir, "v_accounts").withColumn("has_url", (F.col("account_id") % 5 == 0).cast("int")))


_FLAKE = "((epoch_ms(created_at_utc) - 1420070400000) * 4194304 + account_id % 4096)"


@query(f"WITH {_A} SELECT account_id, epoch_us(created_at_utc) // 1000 AS created_ms, date_diff('day', created_at_utc, TIMESTAMP '2024-02-01') AS age_days, round(posts / greatest(date_diff('day', created_at_utc, TIMESTAMP '2024-02-01'), 1), 4) AS message_frequency FROM v_accounts WHERE created_at_utc IS NOT NULL")
def agg34_dat3_members(spark, sf_dir):
    """Creation times out of the high bits of 64-bit ids."""
    rows = load(spark, sf_dir, "v_accounts").where("created_at_utc is not null")
    ids = rows.select("account_id", "posts", (F.call_function("shiftleft", F.unix_millis("created_at_utc") - 1420070400000, F.lit(22)) + F.col("account_id") % 4096).alias("user_id"))
    return aggregates.members(ids, "2024-02-01")


@query(f"WITH {_A} SELECT account_id, round(least((CAST(bio IS NOT NULL AS INT) + CAST(tweets IS NOT NULL AS INT) + CAST(public_repos IS NOT NULL AS INT) + CAST(activity_recency IS NOT NULL AS INT)) / 4, 1), 4) AS data_completeness FROM v_accounts")
def agg35_data_completeness(spark, sf_dir):
    return load(spark, sf_dir, "v_accounts").select("account_id", aggregates.parts_there(["bio", "tweets", "public_repos", "activity_recency"]).alias("data_completeness"))


@query(f"WITH {ctes('v_activity')}, h AS (SELECT account_id, hour(ts) AS h FROM v_activity), m AS (SELECT account_id, count(*) AS n, avg(h) AS m, stddev_samp(h) AS s FROM h GROUP BY account_id) SELECT account_id, CASE WHEN max(n) < 3 THEN NULL ELSE round(avg(pow(h - m, 3)) / greatest(pow(max(s), 3), 1e-9), 4) END AS hour_skew FROM h JOIN m USING (account_id) GROUP BY account_id")
def win4_hour_skew(spark, sf_dir):
    return aggregates.hour_skew(load(spark, sf_dir, "v_activity"))


@query("SELECT event_id, round(CASE event_id % 4 WHEN 0 THEN epoch_us(ts) / 1e6 WHEN 1 THEN CAST(epoch_us(ts) // 1000000 AS DOUBLE) WHEN 2 THEN epoch_us(date_trunc('second', ts)) / 1e6 END, 3) AS seconds FROM events")
def dat1_timestamps(spark, sf_dir):
    """Times as numbers of seconds or as ISO texts; NULL for anything else."""
    k, ts = F.col("event_id") % 4, F.col("ts").cast("timestamp")
    raw = F.when(k == 0, (F.unix_micros(ts) / 1e6).cast("string")).when(k == 1, F.unix_seconds(ts).cast("string")).when(k == 2, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("yesterday")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.round(aggregates.seconds_of(raw), 3).alias("seconds"))


# bundles: joins of what the operators above give
def _joined(parts: list[tuple[str, str]]) -> str:
    first, *rest = [f"(SELECT account_id, {cols} FROM ({ORACLES[name]}))" for name, cols in parts]
    return f"SELECT * FROM {first} " + " ".join(f"FULL JOIN {r} USING (account_id)" for r in rest)


def _bundle(name: str, doc: str, parts: list[tuple[str, str]], finish: str = "") -> None:
    def run(spark, sf_dir):
        return aggregates.bundled([QUERIES[n](spark, sf_dir).selectExpr("account_id", *re.split(r", (?![^(]*\))", cols)) for n, cols in parts])

    run.__name__, run.__doc__ = name, doc
    query(_joined(parts))(run)


_TIME = [("win5_bursts", "burst_share AS burst_score"), ("win1_win3_win6_win7_gaps", "regularity AS posting_regularity_score, gap_max_days AS activity_gap_max, gap_variance AS activity_gap_variance"), ("agg25_rhythm", "hour_entropy AS time_of_day_entropy, active_hours AS active_hours_count, weekend_ratio AS weekend_weekday_ratio, night_share AS night_post_ratio"), ("agg26_rates", "follow_velocity, unfollow_rate, engagement_received_vs_given, reply_to_original_ratio, account_age_vs_activity")]
_bundle("bld14_temporal", "Thirteen features of when and how often accounts act.", _TIME)
_BEHAVIOUR = [("win2_agg16_agg17_entropy", "gap_entropy AS behav_posting_interval_entropy"), ("win1_win3_win6_win7_gaps", "gap_mean AS behav_posting_interval_mean_hr, gap_std AS behav_posting_interval_std_hr, under_minute AS behav_burst_post_count"), ("win4_hour_skew", "hour_skew AS behav_hourly_distribution_skew"), ("agg20_agg24_post_shape", "mean_words AS behav_avg_post_length, var_words AS behav_post_length_variance, url_ratio AS behav_url_post_ratio, self_reply_ratio AS behav_self_reply_ratio"),
              ("str20_reposts", "posts AS behav_post_count, round(1 - reposts / posts, 4) AS behav_original_ratio, CAST(posts < 5 AS INT) AS behav_low_confidence"), ("agg18_type_token", "ratio AS behav_lexical_diversity")]


def _late() -> None:
    """Bundles of queries that other modules register."""
    _bundle("bld15_behaviour", "Features of posting rhythm, wording and repeats, and whether there are too few posts to tell.", _BEHAVIOUR)
    _bundle("bld13_all_features", "Temporal, content, network and consistency features of each account.", [*_TIME, ("agg22_agg23_str19_content", "vocabulary_richness, avg_sentence_length, sentiment_mean, sentiment_variance, emoji_ratio, hashtag_ratio, caps_ratio, url_spam_ratio, mention_spam_ratio"), ("jon12_similar_posts", "ratio AS duplicate_content_ratio"), ("jon13_post_clusters", "clusters AS near_duplicate_cluster_count"), ("jon6_reciprocity", "reciprocity, mutual_ratio"), ("jon9_clustering", "coefficient AS cluster_coefficient"), ("str16_name_similarity", "similarity AS name_username_similarity"), ("str22_language", "consistency AS language_consistency"), ("arr1_presence", "presence AS profile_completeness_score"), ("jon14_topic_similarity", "similarity AS bio_post_topic_similarity")])
