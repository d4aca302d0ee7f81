"""Text features as column expressions: one scan of generated code, no Python rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and code-point ranges that results depend on.
URL = r"https?://|www\."
CRYPTO = r"(?i)\b(?:btc|eth|crypto|airdrop|nft|coin|token|forex|defi)\b"
SPAM = r"(?i)\b(?:free|win|click here|earn|make money|passive income|gain followers|follow back|promo|dm me|link in bio.*earn|investment advisor|99% win rate|get rich)\b"
EMOJI = [(0x1F600, 0x1F64F), (0x1F300, 0x1F5FF), (0x1F680, 0x1F6FF), (0x1F1E0, 0x1F1FF), (0x2600, 0x26FF), (0x2700, 0x27BF), (0x1F900, 0x1F9FF)]
EMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
PHONE = r"(\+?\d[\d\s\-\(\)]{7,}\d)"
BOT_NAMES = [r"^[A-Z][a-z]+[A-Z][a-z]+\d{3,}$", r"^[a-z]+_[a-z]+_\d+$", r"^[a-zA-Z]{2,4}\d{6,}$", r"^\d{8,}$", r"^[a-z]{1,3}\d{4,}[a-z]{0,3}$", r"^(?i)(user|acc|account|bot|fake|spam)\d+"]


def count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern)).cast("long")


def flag(c: Column, pattern: str) -> Column:
    return F.rlike(c, F.lit(pattern)).cast("int")


def share(part: Column, whole: Column) -> Column:
    return F.round(part / F.greatest(whole, F.lit(1)), 4)


def words(c: Column) -> Column:
    """White-space separated words, none empty."""
    return F.filter(F.split(c, r"\s+"), lambda x: x != "")


def emoji_count(c: Column, ranges: list[tuple[int, int]] = EMOJI) -> Column:
    return count(c, "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in ranges) + "]")


def text_features(c: Column, prefix: str) -> dict[str, Column]:
    """Eleven features of a text column; NULL counts as empty."""
    s = F.coalesce(c.cast("string"), F.lit(""))
    n = F.length(s)
    return {
        f"{prefix}_len": n.cast("long"), f"{prefix}_word_count": F.size(words(s)).cast("long"), f"{prefix}_digit_count": count(s, r"\p{Nd}"),
        f"{prefix}_caps_ratio": share(count(s, r"\p{Lu}"), n), f"{prefix}_special_ratio": share(count(s, r"[^\p{L}\p{N}\s]"), n),
        f"{prefix}_has_url": flag(s, URL), f"{prefix}_has_at": F.contains(s, F.lit("@")).cast("int"), f"{prefix}_has_crypto": flag(s, CRYPTO),
        f"{prefix}_has_spam": flag(s, SPAM), f"{prefix}_is_empty": (F.trim(s) == "").cast("int"), f"{prefix}_emoji_count": emoji_count(s),
    }


def username_forensics(c: Column) -> dict[str, Column]:
    """Digit share, digit suffix, special characters, vowel share, consonant run, bot patterns, look-alike characters."""
    letters = F.regexp_replace(F.lower(c), r"[^a-z]", "")
    n = F.length(c)
    run = F.array_max(F.transform(F.split(letters, "[aeiou]"), lambda x: F.length(x)))
    hits = sum((flag(c, p) for p in BOT_NAMES), F.lit(0))
    return {
        "uname_length": n.cast("long"), "uname_digit_ratio": share(count(c, r"\d"), n), "uname_digit_suffix": F.length(F.regexp_extract(c, r"\d+$", 0)).cast("long"),
        "uname_special": count(c, r"[_.\-]"), "uname_vowel_ratio": share(count(letters, "[aeiou]"), F.length(letters)), "uname_consonant_run": share(run, F.length(letters)),
        "uname_bot_hits": hits.cast("int"), "uname_homoglyphs": count(c, r"[^\x00-\x7F]"),
    }
