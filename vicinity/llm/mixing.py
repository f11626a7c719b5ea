"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

A source's documents are wanted ``target / size`` times on average.  The whole part of that is certain and allocated
first.  The fraction p is shared out as unequal inclusion probabilities, longer documents being likelier: with r the
number of binary digits of a document's size and m the mean of r over the source's words, a document is included with
probability p + tilt * (r - m), where the tilt moves the likeliest or the least likely document by ``LEAN`` of the room
that it has.  As r - m is 0 on average over words, the words expected are p of the source's, whatever the tilt.
Documents are ranked by random odds over inclusion odds (Pareto order sampling) and taken in that order until the words
that the source still lacks are reached.  The place in that order is found by summing words over ever finer ranges of
the rank (256 per level), so no source is ever sorted in one task, however large.

Defined results: a null or blank text has size 0 and takes 0; a null source is a source of its own, ordered last; an
empty table gives no rows; ranks depend only on seed and id, so reruns agree; rows that repeat an id rank together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, words

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
SEED = "mix-1"
#: How much of the room between 0 and 1 the inclusion probabilities of a source may use around their mean.
LEAN = 0.5
LEVELS = 3


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``sizes`` (key, source_size and more) with targets, one row per source: proportional to weight up to ``most`` times the size.

    Sources are capped in the order of size over weight; the level is the first at which no later source is above its
    cap.  That is where resharing the excess again and again ends.  One row per source, ordered by code point; the
    rank windows have no partition because they see one row per source, never documents.
    """
    by_key = Window.orderBy("key")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_key) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("weight", w).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    s = s.withColumn("fill", F.col("cap") / F.col("weight"))
    order, every = Window.orderBy("fill", "key"), Window.partitionBy()
    s = s.withColumn("before", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("open_weight", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("level", (F.lit(float(share)) * F.sum("source_size").over(every) - F.col("before")) / F.col("open_weight"))
    # in the order of fill; beyond the first such level the sums are of caps that are not reached
    first = F.min(F.when(F.col("level") <= F.col("fill"), F.struct("fill", "key", "level"))).over(every)
    level = first["level"]
    return s.withColumn("target", F.when(level.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), level * F.col("weight")))).select(*sizes.columns, "target")


def uniform(id_col: Column, seed: str) -> Column:
    """In (0, 1), from 52 bits of a digest of seed and id."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(id_col.cast("string"), F.lit("null"))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def digits(size: Column) -> Column:
    """Binary digits of a size: its logarithm as a whole number, so that sums of it do not depend on order."""
    return F.char_length(F.bin(size)).cast("long")


def tilted(sources: DataFrame, lean: float = LEAN) -> DataFrame:
    """``mean_digits`` and ``tilt`` for sources with p, size_digits (sum of size * digits), low_digits, high_digits: the
    slope of inclusion probabilities by digits that keeps all within ``lean`` of the way from p to 0 and to 1."""
    mean = F.col("size_digits") / F.col("source_size")
    s = sources.withColumn("mean_digits", F.when(F.col("source_size") > 0, mean).otherwise(F.lit(0.0)))
    reach = F.greatest(F.col("high_digits") - F.col("mean_digits"), F.col("mean_digits") - F.col("low_digits"))
    return s.withColumn("tilt", F.when(reach > 0, F.lit(float(lean)) * F.least(F.col("p"), 1 - F.col("p")) / reach).otherwise(F.lit(0.0)))


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
         weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED) -> DataFrame:
    """(doc_id, text_hash, size, source_size, target, copies, inclusion) for each row of ``docs``."""
    source = F.col("source").cast("string")
    base = cut(
        docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"))
        # 's' < 't': a null source comes after every other one
        .select("doc_id", F.xxhash64("text").alias("text_hash"), F.when(source.isNull(), "t").otherwise(F.concat(F.lit("s"), source)).alias("key"),
                F.size(words(F.col("text"))).cast("long").alias("size")),
        "mix-sizes",
    )
    per_source = base.groupBy("key").agg(
        F.sum("size").alias("source_size"), F.sum(F.col("size") * digits(F.col("size"))).alias("size_digits"),
        F.min(digits(F.col("size"))).alias("low_digits"), F.max(digits(F.col("size"))).alias("high_digits"))
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    # a cap that is reached is whole: guard against 2 * size / size falling short of 2
    sources = targets(per_source, weights, share, most).withColumn("whole", F.floor(times + 1e-12).cast("long"))
    sources = cut(
        tilted(sources.withColumn("p", F.greatest(F.lit(0.0), times - F.col("whole"))))
        .withColumn("lacks", F.col("target") - F.col("whole") * F.col("source_size")),
        "mix-sources",
    )
    u, p = uniform(F.col("doc_id"), seed), F.col("inclusion")
    odds = (u / (1 - u)) / (p / (1 - p))
    ranked = base.join(sources, "key").withColumn("inclusion", F.col("p") + F.col("tilt") * (digits(F.col("size")) - F.col("mean_digits")))
    ranked = ranked.withColumn("rank", F.when(F.col("p") > 0, odds / (1 + odds)).otherwise(F.lit(1.0)))

    # Narrow the place where the lacking words are reached: [lo, lo + 256^-level) holds it, `left` words remain there.
    at = sources.where("p > 0").select("key", F.lit(0.0).alias("lo"), F.col("lacks").alias("left"))
    for level in range(1, LEVELS + 1):
        width = 256.0**-level
        inside = ranked.select("key", "rank", "size").join(at, "key").where((F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("lo") + 256 * width))
        steps = inside.groupBy("key", "lo", "left", F.floor((F.col("rank") - F.col("lo")) / width).alias("step")).agg(F.sum("size").alias("size"))
        upto = F.sum("size").over(Window.partitionBy("key").orderBy("step"))
        steps = steps.withColumn("upto", upto).withColumn("open", F.col("upto") > F.col("left"))
        first = steps.where("open").groupBy("key").agg(F.min_by(F.struct("step", (F.col("left") - F.col("upto") + F.col("size")).alias("rest")), "step").alias("first"))
        # no step where the words are reached: all in this range are taken, and the place is its end
        at = cut(
            at.join(first, "key", "left").select(
                "key", (F.col("lo") + F.coalesce(F.col("first.step"), F.lit(256)) * width).alias("lo"), F.coalesce(F.col("first.rest"), F.lit(0.0)).alias("left")),
            f"mix-level{level}",
        )
    inside = ranked.select("key", "rank", "size", "doc_id").join(at, "key").where((F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("lo") + 256.0**-LEVELS))
    before = F.sum("size").over(Window.partitionBy("key").orderBy("rank", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    last = inside.withColumn("before", before).where(F.col("before") + F.col("size") / 2.0 <= F.col("left"))
    last = last.groupBy("key").agg(F.max(F.struct("rank", "doc_id")).alias("last"))
    bound = cut(at.join(last, "key", "left").select("key", "lo", "last"), "mix-bounds")
    taken = (F.col("rank") < F.col("lo")) | (F.struct("rank", "doc_id") <= F.col("last"))
    return ranked.join(bound, "key", "left").select(
        "doc_id", "text_hash", "size", "source_size", "target", (F.col("whole") + F.coalesce(taken, F.lit(False)).cast("long")).alias("copies"), "inclusion")


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """Per document what the mix takes of it."""
    return plan(docs, **options).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The columns of ``docs``, each row as often as the mix takes it."""
    copies = plan(docs, id_col, text_col, **options).groupBy(F.col("doc_id").alias("__vicinity_id"), F.col("text_hash").alias("__vicinity_text_hash")).agg(F.max("copies").alias("__vicinity_copies"))
    on = F.col(id_col).eqNullSafe(F.col("__vicinity_id")) & (F.xxhash64(F.col(text_col)) == F.col("__vicinity_text_hash"))
    out = docs.join(copies.where("__vicinity_copies > 0").hint("shuffle_hash"), on)
    out = out.withColumn("__vicinity_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__vicinity_copies"))))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
