"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with DataFrame functions only.

Every document draws an exponential key -ln(u)/w from a keyed hash, w its quality weight; the documents
with the smallest keys of a source are a weighted sample without replacement.  A source whose target
exceeds its size is taken in complete epochs first, and the fraction left over is the prefix of its
documents in key order whose words fill the rest of the budget.

The prefix sum is two-level, so that a source with a third of all rows is never sorted in one task: the
exact distribution of the keys within a source (a mixture of exponentials, one for each quality grade)
cuts the key order into ranges of equal expected size; sums of ranges are prefix-summed, and only then are the rows of a range.

Defined results: a null text has size 0 and is taken 0 times; null sources form one source, last in
order; ties in the key fall to the smaller doc_id, then to the smaller size; a source without words has target 0; an empty
table gives an empty result; very long texts are counted whole; other columns, whatever their names, are not read (``mixed_documents`` passes them through).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import checkpointed, count_words, whole_text

#: Weights of the sources in code-point order, repeating.
SOURCE_WEIGHTS = (3, 1, 2)
GRADES = 4
ROWS_PER_RANGE = 2000


def quality_grade(text: Column) -> Column:
    """1 to 4: share of letters among all characters, in steps; the quality weight is grade / 4."""
    letters = F.length(F.regexp_replace(text, "[^\\p{L}]", ""))
    share = F.try_divide(letters.cast("double"), F.length(text).cast("double"))
    return F.when(share >= 0.75, 4).when(share >= 0.6, 3).when(share >= 0.4, 2).otherwise(1)


def uniform(seed: int, *parts: Column) -> Column:
    """A number in (0, 1) from 52 bits of a keyed hash; the same on every run."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts)))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def source_targets(sources: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = SOURCE_WEIGHTS) -> DataFrame:
    """Targets of the sources (columns src, source_size): weighted shares, capped, the excess reshared.

    One row per source.  Water filling in closed form: with sources ordered by cap / weight, those before
    the first whose share stays below its cap are at their cap.
    """
    order = Window.orderBy(F.col("src").isNull(), F.col("src"))
    place = (F.row_number().over(order) - 1) % len(weights)
    everything = Window.partitionBy()
    ranked = sources.select("*", F.element_at(F.array(*map(F.lit, weights)), place + 1).cast("double").alias("sw"), (F.col("source_size") * F.lit(float(most))).alias("cap"), (F.sum("source_size").over(everything) * F.lit(float(share))).alias("total"))
    by = Window.orderBy(F.col("cap") / F.col("sw"), F.col("src").isNull(), F.col("src"))
    before, after = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("sw").over(after)
    leveled = ranked.withColumn("level", level)
    # the level of the first source that stays under its cap holds for it and all after it
    free = F.min(F.when(F.col("level") * F.col("sw") <= F.col("cap"), F.struct(F.col("cap") / F.col("sw"), F.col("src").isNull(), F.coalesce("src", F.lit("")), F.col("level").alias("level")))).over(everything)["level"]
    return leveled.withColumn("free", free).select("src", "source_size", *(c for c in sources.columns if c not in ("src", "source_size")), F.coalesce(F.least("cap", F.col("free") * F.col("sw")), F.col("cap")).alias("target"))


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 17, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """doc_id, src, k, size, source_size, target, taken (words, repeats counted) and copies; one row per document.

    The text is read once: what the sampling needs (a few numbers per document) is checkpointed.
    """
    t = whole_text(text)
    u = uniform(seed, F.col(key))
    drawn = df.select(
        F.col(key).alias("doc_id"), F.col(source).alias("src"), count_words(t).alias("size"), quality_grade(t).alias("grade"), u.alias("u")
    ).withColumn("k", -F.log("u") / (F.col("grade") / F.lit(float(GRADES))))
    drawn = checkpointed(drawn)
    per_source = drawn.groupBy("src").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"), *(F.count(F.when(F.col("grade") == g, 1)).alias(f"n{g}") for g in range(1, GRADES + 1)))
    targets = source_targets(per_source, share, most)
    # Some tens of columns of one row per source: salted so that the join deals out a hot source evenly.
    salts = 64
    spread = targets.select("*", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    joined = drawn.withColumn("salt", F.floor(F.col("u") * 1e6).cast("int") % salts).alias("d").join(spread.alias("s"), F.col("d.src").eqNullSafe(F.col("s.src")) & (F.col("d.salt") == F.col("s.salt")))
    below = sum(((F.col(f"s.n{g}") / F.col("s.n")) * (1 - F.exp(-F.col("d.k") * (g / GRADES))) for g in range(1, GRADES + 1)), F.lit(0.0))
    at = F.floor(below * F.ceil(F.col("s.n") / ROWS_PER_RANGE)).cast("long")
    placed = joined.select("d.doc_id", "d.src", "d.size", "d.k", "s.source_size", "s.target", at.alias("at"))
    # the sums of all ranges of one source: as many rows as documents / ROWS_PER_RANGE
    sums = placed.groupBy("src", "at").agg(F.sum("size").alias("range_size"))
    ahead = sums.select("src", "at", F.coalesce(F.sum("range_size").over(Window.partitionBy("src").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("src", "at").orderBy("k", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.withColumn("upto", F.sum("size").over(inside))
    full = summed.alias("p").join(ahead.alias("a"), F.col("p.src").eqNullSafe(F.col("a.src")) & (F.col("p.at") == F.col("a.at")))
    epochs = F.when(F.col("p.source_size") > 0, F.floor(F.col("p.target") / F.col("p.source_size"))).otherwise(0).cast("long")
    rest = F.col("p.target") - epochs * F.col("p.source_size")
    # a document is in the fraction if its end is nearer to the budget than its start
    middle = F.col("a.ahead") + F.col("p.upto") - F.col("p.size") / F.lit(2.0)
    copies = epochs + F.when((middle <= rest) & (F.col("p.size") > 0) & (epochs < F.lit(int(most))), 1).otherwise(0)
    return full.select("p.doc_id", "p.src", "p.k", "p.size", "p.source_size", "p.target", (copies * F.col("p.size")).alias("taken"), copies.alias("copies"))


def mixed_documents(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 17) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of the input.

    Taken documents of a source are those up to a cut in key order, so the text is never shuffled: one row
    per source (its copies and its cut) is joined to the documents, broadcast only while there are
    at most 10,000 sources.  Rows that share source, key and size share their fate.
    """
    names = df.columns
    chosen = checkpointed(mix(df, key, text, source, seed))
    u = uniform(seed, F.col("d.__key"))
    cuts = chosen.where("size > 0").groupBy("src").agg(F.max("copies").alias("top"), F.min("copies").alias("low"))
    last = chosen.where("size > 0").groupBy("src", "copies").agg(F.max("k").alias("cut"))
    cuts = checkpointed(cuts.alias("c").join(last.alias("l"), F.col("c.src").eqNullSafe(F.col("l.src")) & (F.col("c.top") == F.col("l.copies"))).select("c.src", "top", "low", "cut"))
    cuts = F.broadcast(cuts) if cuts.count() <= 10_000 else cuts
    docs = df.select(F.struct(*(F.col(f"`{n}`") for n in names)).alias("row"), F.col(key).alias("__key"), F.col(source).alias("__src"), quality_grade(whole_text(text)).alias("__grade"))
    k = -F.log(u) / (F.col("d.__grade") / F.lit(float(GRADES)))
    joined = docs.alias("d").join(cuts.alias("c"), F.col("d.__src").eqNullSafe(F.col("c.src")))
    copies = F.when(k <= F.col("c.cut"), F.col("c.top")).otherwise(F.col("c.low")).cast("int")
    return joined.select(F.explode(F.array_repeat(F.col("d.row"), copies)).alias("row")).select("row.*")


ORACLE = r"""
WITH d AS (SELECT doc_id, source AS src, coalesce(text, '') AS t FROM documents),
g AS (SELECT doc_id, src, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+'))::BIGINT AS size,
  length(regexp_replace(t, '[^\p{L}]', '', 'g'))::DOUBLE / nullif(length(t), 0)::DOUBLE AS sh,
  (('0x' || substr(md5('17|' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u FROM d),
k AS (SELECT *, -ln(u) / ((CASE WHEN sh >= 0.75 THEN 4 WHEN sh >= 0.6 THEN 3 WHEN sh >= 0.4 THEN 2 ELSE 1 END) / 4.0::DOUBLE) AS k FROM g),
s AS (SELECT src, sum(size)::BIGINT AS source_size FROM k GROUP BY src),
w AS (SELECT *, ([3, 1, 2])[((row_number() OVER (ORDER BY src IS NULL, src) - 1) % 3 + 1)::INT]::DOUBLE AS sw, source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS total FROM s),
l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / sw, src IS NULL, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
  / sum(sw) OVER (ORDER BY cap / sw, src IS NULL, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT *, (SELECT arg_min(level, cap / sw) FROM l WHERE level * sw <= cap) AS free FROM l),
tg AS (SELECT src, source_size, coalesce(least(cap, free * sw), cap) AS target FROM f),
j AS (SELECT k.doc_id, k.size, tg.source_size, tg.target, CASE WHEN tg.source_size > 0 THEN floor(tg.target / tg.source_size)::BIGINT ELSE 0 END AS ep,
  sum(k.size) OVER (PARTITION BY k.src ORDER BY k.k, k.doc_id NULLS LAST, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM k JOIN tg ON k.src IS NOT DISTINCT FROM tg.src)
SELECT doc_id, size, source_size, target, (size * (ep + CASE WHEN upto - size / 2.0 <= target - ep * source_size AND size > 0 AND ep < 2 THEN 1 ELSE 0 END))::BIGINT AS taken FROM j
"""
