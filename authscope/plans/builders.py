"""Registered queries of the platform feature builders, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from authscope.functions import text as T
from authscope.operators import builders, profiles
from authscope.plans.registry import query
from authscope.sources.views import ctes, load

_EMOJI = "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in T.EMOJI) + "]"
_ACCOUNTS = ctes("v_accounts")
#: Columns of a file of ready-made features, made from accounts.
READY = {"#followers": "followers", "#follows": "following", "#posts": "posts", "profile pic": "profile_pic", "nums/length username": "fork_ratio", "fullname words": "unique_languages", "nums/length fullname": "readme_presence_ratio", "name==username": "has_avatar", "description length": "public_gists", "external url": "default_profile_image", "private": "streaks"}


def _text(c: str, kind: str) -> str:
    n = lambda pattern: f"CAST(len(regexp_extract_all({c}, '{pattern}')) AS BIGINT)"
    is_ = lambda pattern: f"CAST(regexp_matches({c}, '{pattern}') AS INT)"
    return {
        "len": f"length({c})", "digit_count": n(r"\p{Nd}"), "underscore": n("_"), "hyphen": n("-"), "pure_numeric": f"CAST(regexp_full_match({c}, '\\p{{Nd}}+') AS INT)", "word_count": n(r"\S+"),
        "has_url": is_(r"https?://|www\."), "has_at": f"CAST(contains({c}, '@') AS INT)", "has_crypto": is_(T.CRYPTO), "has_spam": is_(T.SPAM), "is_empty": f"CAST(trim({c}) = '' AS INT)",
        "is_filled": f"CAST(trim({c}) <> '' AS INT)", "emoji_count": n(_EMOJI), "caps_ratio": f"round(len(regexp_extract_all({c}, '\\p{{Lu}}')) / greatest(length({c}), 1), 4)",
        "all_caps": f"CAST({c} = upper({c}) AS INT)", "has_pipe": f"CAST(contains({c}, '|') AS INT)",
    }[kind]


def _made(spec: tuple, of: dict[str, str]) -> str:
    kind, _, *a = spec
    by = lambda x, y: f"{x} / CASE WHEN {y} = 0 THEN 1 ELSE {y} END"
    match kind:
        case "num":
            return f"""coalesce({", ".join(f'CAST("{c}" AS DOUBLE)' for c in a[0])}, {float(a[1])})"""
        case "num_most":
            return f"least(coalesce(CAST({a[0][0]} AS DOUBLE), {float(a[1])}), {float(a[2])})"
        case "own_pic":
            return f"coalesce(CAST(1 - {a[1]} AS DOUBLE), 1.0)"
        case "ratio":
            return f"round({by(*(f'CAST({of[x]} AS DOUBLE)' for x in a[:2]))}, 4)"
        case "ratio100":
            return f"round({by(of[a[0]], of[a[1]])} * 100, 4)"
        case "ratio_most":
            return f"round(least({by(of[a[0]], of[a[1]])}, {float(a[2])}), 4)"
        case "log":
            return f"round(ln(1 + greatest({of[a[0]]}, 0)), 4)"
        case "tier":
            return f"CAST(CASE WHEN {of[a[0]]} <= -1 THEN NULL " + " ".join(f"WHEN {of[a[0]]} <= {t} THEN {k}" for k, t in enumerate(a[1])) + f" ELSE {len(a[1])} END AS DOUBLE)"
        case "star":
            return f"CAST(is_verified = 1 AND {of[a[0]]} > {a[1]} AS INT)"
        case "is":
            return f"CAST({of[a[0]]} {a[1]} {a[2]} AS INT)"
        case "sum":
            return " + ".join(of[x] for x in a)
        case "seconds":
            return f"coalesce((epoch_us({a[1]}) - epoch_us({a[0]})) / 1e6, 0.0)"
    return _text(f"coalesce(CAST({a[0]} AS VARCHAR), '')", a[1])


def _scale(followers: str, posts: str) -> str:
    f, d = f"coalesce({followers}, 0)", "account_age_days"
    return f"""round(log10(greatest({f}, 1)), 4) AS celeb_log_followers, CASE WHEN {f} < 100 THEN 0 WHEN {f} < 1000 THEN 1 WHEN {f} < 10000 THEN 2 WHEN {f} < 100000 THEN 3 WHEN {f} < 1000000 THEN 4 WHEN {f} < 10000000 THEN 5 ELSE 6 END AS celeb_followers_tier,
 CAST({f} >= 500000 AS INT) AS celeb_is_celebrity_scale, round({posts} / greatest({f}, 1), 4) AS celeb_posts_per_follower, round(CASE WHEN {d} > 0 THEN {f} / {d} ELSE 0 END, 4) AS celeb_follower_per_day,
 round(CASE WHEN {d} > 0 THEN {posts} / {d} * 365 ELSE 0 END, 4) AS celeb_posts_per_year, CAST(following <= 1000 AS INT) AS celeb_following_capped_1000, CAST(following <= 5000 AS INT) AS celeb_following_capped_5000,
 round({f} / greatest(following, 1) / greatest(log10(greatest({f}, 1)), 1), 4) AS celeb_normalized_ratio, CAST(is_verified = 1 AND {f} >= 100000 AS INT) AS celeb_verified_celebrity, CAST(is_verified = 1 AND {f} < 100000 AS INT) AS celeb_verified_micro,
 CASE WHEN {d} >= 1825 AND {f} >= 100000 THEN 1.0E0 WHEN {d} >= 730 AND {f} >= 10000 THEN 0.7 WHEN {d} >= 365 AND {f} >= 1000 THEN 0.4 ELSE 0.1 END AS celeb_account_maturity_score"""


def _sql(platform: str, source: str, posts: str) -> str:
    of: dict[str, str] = {}
    for spec in builders.BUILDERS[platform]:
        of[spec[1]] = f"({_made(spec, of)})"
    cols = ", ".join(f"{e} AS {n}" for n, e in of.items() if n[0] != "_")
    scale = f", {_scale('followers', posts)}" if platform in builders.WITH_SCALE else ""
    return f"WITH {_ACCOUNTS}, s AS ({source}) SELECT account_id, {cols}{scale} FROM s"


_READY = "SELECT account_id, " + ", ".join(f'{c} AS "{n}"' for n, c in READY.items()) + ", is_verified, account_age_days FROM v_accounts WHERE platform = 'instagram'"
#: Columns each platform's files have.
COLUMNS = {
    "instagram": "username, bio, followers, following, posts, is_verified, profile_pic, account_age_days", "facebook": "name, about AS bio, friends, followers, following, posts, is_verified, profile_pic, account_age_days",
    "x": "username, bio, followers, following, tweets, statuses_count, posts, listed_count, is_verified, default_profile_image, account_age_days", "linkedin": "name, headline, about, connections, followers, endorsements, profile_pic",
    "github": "username, bio, followers, following, public_repos, repos, public_gists, account_age_days, star_received_total, fork_ratio, readme_presence_ratio, unique_languages, repo_diversity_score, activity_recency, commit_regularity",
    "discord": "username, created_at_utc, joined_at_utc, account_age_days, has_avatar, suspicion_score", "youtube": "channel_name, about, subscribers, subscribers AS followers, following, videos, avg_views, is_verified, account_age_days",
    "tiktok": "username, bio, followers, following, videos, posts, likes, is_verified, account_age_days", "reddit": "username, about, karma, comment_karma, post_karma, account_age_days", "snapchat": "username, bio, score, friends_count, streaks",
}
_OR = lambda *names: "coalesce(" + ", ".join(f"nullif({n}, 0)" for n in names) + ", 0)"
POSTS = {"instagram": "posts", "facebook": "posts", "x": _OR("posts", "tweets"), "youtube": _OR("videos"), "tiktok": _OR("posts", "videos")}


def files_of(spark, sf_dir, platform):
    """The rows and columns a file of that platform has."""
    return load(spark, sf_dir, "v_accounts").where(F.col("platform") == platform).selectExpr("account_id", *COLUMNS[platform].split(", "))


def _register(number: str, platform: str) -> None:
    extra = ", CAST(CASE WHEN (SELECT greatest(sum(comment_karma), sum(post_karma)) FROM v_accounts WHERE platform = 'reddit') > 0 THEN comment_karma + post_karma ELSE karma END AS DOUBLE) AS total_karma" if platform == "reddit" else ""
    source = f"SELECT account_id, {COLUMNS[platform]}{extra} FROM v_accounts WHERE platform = '{platform}'"
    spec = _sql(platform, source, POSTS.get(platform, "0"))
    if platform == "instagram":
        spec = spec.replace('CAST("has_profile_pic" AS DOUBLE), ', "")
    if platform in ("facebook",):
        spec = spec.replace('CAST("has_profile_pic" AS DOUBLE), ', "")
    if platform == "linkedin":
        spec = spec.replace('CAST("has_photo" AS DOUBLE), ', "")

    def run(spark, sf_dir):
        return builders.build(files_of(spark, sf_dir, platform), platform)

    run.__name__, run.__doc__ = f"bld{number}_{platform}_features", f"Feature table of {platform} accounts."
    query(spec)(run)


for _n, _p in (("1", "instagram"), ("3", "facebook"), ("4_str1", "x"), ("5_str23", "linkedin"), ("6", "github"), ("7_dat2", "discord"), ("8", "youtube"), ("9", "tiktok"), ("10", "reddit"), ("11", "snapchat")):
    _register(_n, _p)


@query(_sql("instagram_precomputed", _READY, "0"))
def bld2_instagram_ready_features(spark, sf_dir):
    """Files of ready-made features are told by their columns."""
    p = load(spark, sf_dir, "v_accounts").where("platform = 'instagram'")
    ready = p.select("account_id", *[F.col(c).alias(n.upper() if n == "private" else n) for n, c in READY.items()], "is_verified")
    return builders.build(ready, "instagram")


@query(f"WITH {ctes('v_profiles')} SELECT account_id, {_scale('followers', 'posts').replace('celeb_', '')} FROM v_profiles")
def bld12_scale_features(spark, sf_dir):
    df = load(spark, sf_dir, "v_profiles")
    cols = profiles.scale_features({c: F.col(c) for c in ("followers", "following", "posts", "account_age_days", "is_verified")})
    return df.select("account_id", *[v.alias(k) for k, v in cols.items()])
