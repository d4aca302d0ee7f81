"""Secret scans (operator 9): a trigram inverted index, DataFrame functions only.

Each rule's regular expression is turned into a Boolean query: strings that a match must hold, as an AND of ORs of ANDs
of trigrams of lower-case text. Postings (trigram -> rows) are kept for the rules' trigrams alone, so a row gives as many
as the rules have at most; intersecting them gives candidates, which the expressions then verify. Rules without mandatory
trigrams scan every text.

A rule's matches are leftmost and do not overlap; those whose value is too short are dropped after matching. Offsets
are code points, end exclusive. NULL text counts as empty and has no spans. Rows are told apart by id and a hash of
the text; rows of NULL id take part; repeated rows each give a row. Other columns are left out.
"""

from __future__ import annotations

import re._constants as c
import re._parser as parser
from itertools import product
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from authscope.llm.common import cut


class Rule(NamedTuple):
    kind: str
    pattern: str
    group: int
    least: int


#: The first three are the base rules; the others add spans.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 0),
)
BASE = 3
MOST_STRINGS = 64


def required(items) -> list[set[str]]:
    """Runs of neighbouring items, each as the set of strings it can be, that every match holds."""
    runs: list[set[str]] = []
    open_run: set[str] = {""}

    def close() -> None:
        nonlocal open_run
        runs.append(open_run)
        open_run = {""}

    def exact(op, arg) -> set[str] | None:
        if op is c.LITERAL:
            return {chr(arg)}
        if op is c.IN and all(k is c.LITERAL for k, _ in arg) and len(arg) <= 8:
            return {chr(v) for _, v in arg}
        if op is c.SUBPATTERN:
            return whole(arg[3])
        if op is c.BRANCH:
            parts = [whole(x) for x in arg[1]]
            return None if None in parts else set().union(*parts)
        if op is c.MAX_REPEAT and arg[0] == 0 and arg[1] == 1:
            part = whole(arg[2])
            return None if part is None else part | {""}
        return None

    def whole(seq) -> set[str] | None:
        out = {""}
        for op, arg in seq:
            part = exact(op, arg)
            if part is None or len(out) * len(part) > MOST_STRINGS:
                return None
            out = {a + b for a, b in product(out, part)}
        return out

    for op, arg in items:
        part = exact(op, arg)
        if part is not None and len(open_run) * len(part) <= MOST_STRINGS:
            open_run = {a + b for a, b in product(open_run, part)}
        elif op is c.SUBPATTERN:
            close()
            runs += required(arg[3])
        else:
            close()
            if op is c.MAX_REPEAT and arg[0] >= 1:
                runs += required(arg[2])
    close()
    return runs


def trigrams(s: str) -> frozenset[str]:
    s = s.lower()
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """AND of clauses; a clause is an OR of sets of trigrams. Empty: no trigram is mandatory."""
    clauses = []
    for run in required(parser.parse(pattern)):
        options = {trigrams(s) for s in run}
        if frozenset() not in options:
            clauses.append(sorted((o for o in options if not any(p < o for p in options)), key=sorted))
    return clauses


def rows_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).withColumn("th", F.xxhash64("text"))


def index(df: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings (trigram, id, th) of the rules' trigrams."""
    wanted = sorted(set().union(*(o for r in rules for clause in trigram_query(r.pattern) for o in clause)))
    rows = rows_of(df, id_col, text_col).select("id", "th", F.lower("text").alias("low"))
    hits = F.filter(F.array(*map(F.lit, wanted)), lambda t: F.contains(F.col("low"), t))
    return rows.select("id", "th", F.explode(hits).alias("trigram"))


def candidates(postings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(id, th, rules): the indexed rules each row may match. The queries' table has a row for each rule, option and trigram: its size is the rules'."""
    terms = [(t, r, k, o, len(option), len(clauses)) for r, rule in enumerate(rules) for clauses in [trigram_query(rule.pattern)] for k, clause in enumerate(clauses) for o, option in enumerate(clause) for t in sorted(option)]
    queries = postings.sparkSession.createDataFrame(terms, "trigram string, rule int, clause int, option int, size int, clauses int")
    met = postings.join(F.broadcast(queries), "trigram").groupBy("id", "th", "rule", "clause", "option", "size", "clauses").agg(F.count_distinct("trigram").alias("n"))
    whole = met.where("n = size").groupBy("id", "th", "rule", "clauses").agg(F.count_distinct("clause").alias("n")).where("n = clauses")
    return whole.groupBy("id", "th").agg(F.collect_set("rule").alias("rules"))


def spans(df: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", postings: DataFrame | None = None) -> DataFrame:
    """(id, th, rule, start, end): every verified span; ``rule`` is the rule's place in ``rules``.

    ``postings`` may be a table that :func:`index` made before, for rules whose trigrams include those of ``rules``.
    """
    postings = cut(index(df, rules, id_col, text_col)) if postings is None else postings
    found = candidates(postings, rules).select(F.col("id").alias("_i"), F.col("th").alias("_t"), "rules")
    rows = rows_of(df, id_col, text_col)
    rows = rows.join(found, F.col("id").eqNullSafe(F.col("_i")) & (F.col("th") == F.col("_t")), "left").select("id", "th", "text", "rules")
    never = F.lit(None).cast("array<string>")

    def matches(k: int, r: Rule) -> Column:
        hit = F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0))
        return F.when(F.array_contains("rules", k), hit).otherwise(never) if trigram_query(r.pattern) else hit

    rows = rows.select("id", "th", "text", F.array(*[matches(k, r) for k, r in enumerate(rules)]).alias("hits"))
    rows = rows.where(F.exists("hits", lambda x: F.size(x) > 0)).select("id", "th", "text", F.posexplode("hits").alias("rule", "whole")).where(F.size("whole") > 0)
    pick = lambda make: F.element_at(F.array(*[make(r) for r in rules]), F.col("rule") + 1)

    def chosen(make) -> Column:
        out = make(rules[-1])
        for k, r in list(enumerate(rules))[-2::-1]:
            out = F.when(F.col("rule") == k, make(r)).otherwise(out)
        return out

    parts = chosen(lambda r: F.split("text", r.pattern, -1))
    values = chosen(lambda r: F.regexp_extract_all("text", F.lit(r.pattern), F.lit(r.group)) if r.group else F.col("whole"))
    zipped = F.arrays_zip(F.slice(parts, F.lit(1), F.size("whole")).alias("part"), F.col("whole").alias("whole"), values.alias("value"))
    each = rows.select("id", "th", "rule", F.posexplode(zipped).alias("at", "m"))
    each = each.select("id", "th", "rule", "at", F.length("m.part").alias("gap"), F.length("m.whole").alias("size"), F.length("m.value").alias("n")).distinct()
    end = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("id", "th", "rule").orderBy("at"))
    each = each.withColumn("end", end)
    return each.where(F.col("n") >= pick(lambda r: F.lit(r.least))).select("id", "th", "rule", (F.col("end") - F.col("size")).alias("start"), "end")


def scan(df: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: numbers of base spans, a digest of them, and all spans as text."""
    found = spans(df, rules, id_col, text_col)
    name = F.element_at(F.array(*[F.lit(r.kind) for r in rules]), F.col("rule") + 1)
    one = F.struct("start", "rule", "end", F.concat_ws(":", name, F.col("start").cast("string"), F.col("end").cast("string")).alias("text"))
    counts = [F.count_if(F.col("rule") == k).alias(f"n_{rules[k].kind}") for k in range(BASE)]
    listed = found.groupBy(F.col("id").alias("_i"), F.col("th").alias("_t")).agg(F.array_sort(F.collect_list(one)).alias("all"), *counts)
    joined = lambda a: F.array_join(F.transform(a, lambda x: x["text"]), ",")
    listed = listed.select("_i", "_t", *[f"n_{rules[k].kind}" for k in range(BASE)], joined(F.filter("all", lambda x: x["rule"] < BASE)).alias("_base"), joined(F.col("all")).alias("spans"))
    rows = rows_of(df, id_col, text_col).select("id", "th")
    rows = rows.join(listed, F.col("id").eqNullSafe(F.col("_i")) & (F.col("th") == F.col("_t")), "left")
    zero = lambda n: F.coalesce(F.col(n), F.lit(0)).cast("long").alias(n)
    return rows.select(F.col("id").alias(id_col), *[zero(f"n_{rules[k].kind}") for k in range(BASE)], F.sha2(F.coalesce("_base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))
