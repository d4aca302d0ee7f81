"""Document fingerprints (operator 2): SimHash votes and permuted block tables, DataFrame functions only.

Terms are pairs of neighbouring lower-cased words (the last word stands alone); a term weighs its length in
code points, at most 16. A term's 64-bit hash votes with its weight on each bit. Two bits share one 64-bit sum, 32 bits
each, so a text of up to 2**27 words has exact votes; the sums are partial before the shuffle, a row for each text.

NULL text counts as empty; an empty text has the fingerprint of all zeros. Rows of NULL id are documents too and come
last in descending order. Repeated rows each give a row. Other columns of the input are left out.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from authscope.llm.common import cut

BITS = 64
MOST_WEIGHT = 16
#: Ids per bucket in which neighbours by id are found, as powers of two: rows, then buckets.
NEAR_BITS, FAR_BITS = 6, 10


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits of two fingerprints."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def shown(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def simhash(df: DataFrame, text_col: str, keys: list[str]) -> DataFrame:
    """(keys, fp long, rows long): the fingerprint for each distinct ``keys``; rows of equal keys must have equal texts."""
    words = df.select(*keys, F.split(F.lower(F.col(text_col)), r"[\x20\x09-\x0D]+").alias("_words"))
    terms = words.select(*keys, "_words", F.posexplode("_words").alias("_at", "_word"))
    following = F.get("_words", F.col("_at") + 1)
    weight = F.least(F.length("_word") + F.coalesce(F.length(following), F.lit(0)), F.lit(MOST_WEIGHT)).cast("long")
    terms = terms.select(*keys, (F.col("_at") == 0).cast("long").alias("_row"), weight.alias("_w"), F.xxhash64("_word", following).alias("_h"))
    pair = (1 << 32) + 1
    votes = [F.sum(F.col("_w") * F.shiftrightunsigned("_h", b).bitwiseAND(F.lit(pair))).alias(f"_v{b}") for b in range(BITS // 2)]
    summed = terms.groupBy(*keys).agg(F.sum("_w").alias("_all"), F.sum("_row").alias("rows"), *votes)
    low = lambda b: F.col(f"_v{b}").bitwiseAND(F.lit((1 << 32) - 1))
    high = lambda b: F.shiftrightunsigned(f"_v{b}", 32)
    bit = lambda v, k: F.when(v * 2 > F.col("_all"), F.lit((1 << k) - ((1 << 64) if k == 63 else 0)).cast("long")).otherwise(F.lit(0).cast("long"))
    bits = [bit(low(b), b) for b in range(BITS // 2)] + [bit(high(b), b + 32) for b in range(BITS // 2)]
    return summed.select(*keys, "rows", reduce(lambda a, b: a.bitwiseOR(b), bits).alias("fp"))


def with_next(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, th, next_id, next_text, next_th) by descending id, after the last the first; th: a hash of the text.

    Texts meet in buckets of 64 ids; the first row of each bucket is also dealt to the bucket before it, so one
    shuffle of the texts and a 64th of them does. The order of buckets is found on their numbers alone, level by level: no
    window holds more than 2**``FAR_BITS`` of a level's numbers, whatever the ids are like.
    """
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)).cast("long"))
    rows = df.select(F.col(id_col).cast("long").alias("id"), key.alias("_k"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumns({"th": F.xxhash64("text"), "_b": F.shiftright("_k", NEAR_BITS), "_ghost": F.lit(0)})
    levels = [rows.groupBy("_b").agg(F.min("_b").alias("_low"))]  # a level's numbers, each with the least bucket below it
    for _ in range(-(-(64 - NEAR_BITS) // FAR_BITS)):
        levels.append(levels[-1].groupBy(F.shiftright("_b", FAR_BITS).alias("_b")).agg(F.min("_low").alias("_low")))
    # _up: the least bucket of the next number above, which in descending order comes before
    up = levels[-1].select("_b", F.lag("_low").over(Window.orderBy(F.desc("_b"))).alias("_up"))  # two numbers at most
    for level in levels[-2::-1]:
        parent = F.shiftright(F.col("a._b"), FAR_BITS)
        met = level.alias("a").join(up.alias("u"), parent == F.col("u._b")).select("a._b", "a._low", F.col("u._up").alias("_over"), parent.alias("_p"))
        up = met.select("_b", F.coalesce(F.lag("_low").over(Window.partitionBy("_p").orderBy(F.desc("_b"))), "_over").alias("_up"))
    least = levels[-1].agg(F.min("_low").alias("_least"))
    to = up.crossJoin(F.broadcast(least)).select("_b", F.coalesce("_up", "_least").alias("_to"))  # one number
    heads = rows.groupBy("_b").agg(F.max_by(F.struct("id", "text", "th"), F.struct("_k", "th")).alias("_h"), F.max("_k").alias("_k"))
    ghosts = heads.join(to, "_b").select("_h.id", "_k", "_h.text", "_h.th", F.col("_to").alias("_b"), F.lit(1).alias("_ghost"))
    order = Window.partitionBy("_b").orderBy("_ghost", F.desc("_k"), F.desc("th"))
    after = rows.unionByName(ghosts).withColumns({f"next_{c}": F.lead(c).over(order) for c in ("id", "text", "th")})
    return after.where("_ghost = 0").drop("_k", "_b", "_ghost")


def edited_likeness(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 20, radius: int = 3) -> DataFrame:
    """A row for each document: fingerprints of its text and of its edited text, and their likeness.

    ``n_within``: how many other documents' fingerprints lie within ``radius`` bits, found through the block tables, for rows
    whose id ``every`` divides; NULL for others.
    """
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = with_next(df, id_col, text_col).withColumn("n_chars", F.length("text").cast("long"))
    rows = rows.withColumn("edited", F.concat(F.expr("substring(text, 1, cast(n_chars - floor(n_chars / 2) as int))"), F.substring("next_text", F.lit(1), half)))
    rows = rows.select("id", "n_chars", "th", "next_id", "next_th", F.sha2("edited", 256).alias("edited_sha256"), F.explode(F.array(F.struct(F.lit(0).alias("role"), F.col("text").alias("t")), F.struct(F.lit(1).alias("role"), F.col("edited").alias("t")))).alias("_x"))
    keys = ["id", "n_chars", "th", "next_id", "next_th", "edited_sha256"]
    fps = cut(simhash(rows.select(*keys, "_x.role", "_x.t"), "t", [*keys, "role"]))  # numbers only
    own = fps.groupBy(*keys).agg(F.max(F.when(F.col("role") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("role") == 1, F.col("fp"))).alias("edited_fp"), F.max("rows").alias("rows"))
    after = fps.where("role = 0").groupBy(F.col("id").alias("_i"), F.col("th").alias("_t")).agg(F.max("fp").alias("next_fp"))
    both = own.join(after, F.col("next_id").eqNullSafe(F.col("_i")) & (F.col("next_th") == F.col("_t")), "left")
    copies = fps.where("role = 0").groupBy("fp").agg(F.sum("rows").alias("copies"))
    asked = fps.where(f"role = 0 and id % {every} = 0").select("fp").distinct()
    near = within(asked, copies.select("fp"), radius).join(copies, "fp").groupBy(F.col("query_fp").alias("_fp")).agg((F.sum("copies") - 1).alias("n_within"))
    found = both.join(near, F.col("fp") == F.col("_fp"), "left").withColumn("n_within", F.when(F.col("id") % every == 0, F.col("n_within")))
    return found.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int")))).select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", shown(F.col("fp")).alias("fingerprint"), shown(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"), "n_within",
    )


def block_masks(radius: int, blocks: int) -> list[int]:
    """For each table, the bits of the ``blocks - radius`` blocks that it brings to the front."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    masks = [sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in kept) for kept in combinations(range(blocks), blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def block_tables(fps: DataFrame, radius: int = 3, blocks: int = 6, fp_col: str = "fp") -> DataFrame:
    """(table, prefix, fp): each distinct fingerprint in every permuted table.

    Fingerprints that differ in at most ``radius`` bits have at least ``blocks - radius`` blocks alike, so they share a prefix in some table.
    """
    tables = F.array(*[F.struct(F.lit(k).alias("table"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("prefix")) for k, m in enumerate(block_masks(radius, blocks))])
    return fps.select(F.col(fp_col).alias("fp")).where("fp is not null").distinct().select("fp", F.explode(tables).alias("_t")).select("_t.table", "_t.prefix", "fp")


def within(queries: DataFrame, fps: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """(query_fp, fp, distance): all distinct fingerprints of ``fps(fp)`` within ``radius`` bits of each distinct one of ``queries(fp)``.

    Between distinct fingerprints only: copies are one row each, and join back by fp. A table's prefix spans half of the
    bits, so even a frequent one is shared only by fingerprints that nearly agree. A pair comes from the first table both share.
    """
    q = block_tables(queries, radius, blocks).withColumnRenamed("fp", "query_fp")
    x = F.col("query_fp").bitwiseXOR(F.col("fp"))
    first = F.lit(None).cast("int")
    for k, m in list(enumerate(block_masks(radius, blocks)))[::-1]:
        first = F.when(x.bitwiseAND(F.lit(m).cast("long")) == 0, k).otherwise(first)
    met = q.hint("merge").join(block_tables(fps, radius, blocks), ["table", "prefix"]).where((F.bit_count(x) <= radius) & (F.col("table") == first))
    return met.select("query_fp", "fp", F.bit_count(x).alias("distance"))
