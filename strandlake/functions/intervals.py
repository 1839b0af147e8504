"""Sweeps along contigs: coverage, holes, islands, collated segments and merged tags.

A sweep runs inside bins of positions; what a bin takes over from those before it comes from one row per bin, so a long
contig is swept by many tasks; what starts within one bin is sorted by one, which spills if need be.  Intervals with a null start or contig are left out by ``swept``; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.functions.mappings import BIN, KEYS
from strandlake.operators.components import kept


def swept(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], how: Callable[[str], Column], value: str, name: str, inclusive: bool = False, size: int = BIN) -> DataFrame:
    """``rows`` with ``name``: how(value) over the rows of ``keys`` before each in ``order`` (its first column a position), with itself if ``inclusive``.

    ``how`` is F.max or F.sum; null if there is nothing before.
    """
    at = rows.where(F.col(order[0]).isNotNull()).withColumn("bin", F.floor(F.col(order[0]) / size))
    line = W.partitionBy(*keys).orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    bins = at.groupBy(*keys, "bin").agg(how(value).alias("v")).select(*keys, "bin", how("v").over(line).alias("carry"))
    inner = how(value).over(W.partitionBy(*keys, "bin").orderBy(*order).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1))
    both = at.withColumn("inner", inner).join(bins, [*keys, "bin"])
    summed = F.when(F.col("carry").isNull(), F.col("inner")).when(F.col("inner").isNull(), F.col("carry"))
    total = F.greatest("carry", "inner") if how is F.max else summed.otherwise(F.col("carry") + F.col("inner"))
    return both.withColumn(name, total).drop("bin", "inner", "carry")


def coverage(mappings: DataFrame, size: int = BIN) -> DataFrame:
    """contig_id, first_base, last_base, depth of every stretch between two changes of depth, inner stretches of depth 0 included."""
    events = mappings.select("contig_id", F.inline(F.array(F.struct(F.col("cstart").alias("pos"), F.lit(1).alias("d")), F.struct((F.col("cfinish") + 1).alias("pos"), F.lit(-1).alias("d")))))
    steps = events.groupBy("contig_id", "pos").agg(F.sum("d").alias("d")).withColumn("bin", F.floor(F.col("pos") / size))
    line, inner = W.partitionBy("contig_id").orderBy("bin"), W.partitionBy("contig_id", "bin").orderBy("pos")
    bins = steps.groupBy("contig_id", "bin").agg(F.sum("d").alias("v"), F.min("pos").alias("p")).select(
        "contig_id", "bin", F.coalesce(F.sum("v").over(line.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("carry"), F.lead("p").over(line).alias("beyond"))
    at = steps.withColumns({"run": F.sum("d").over(inner), "next": F.lead("pos").over(inner)}).join(bins, ["contig_id", "bin"])
    end = F.coalesce("next", "beyond")
    return at.where(end.isNotNull()).select("contig_id", F.col("pos").alias("first_base"), (end - 1).alias("last_base"), (F.col("carry") + F.col("run")).alias("depth"))


def holes(mappings: DataFrame) -> DataFrame:
    """contig_id, seq_id, cstart, reach: reads that start beyond everything before them."""
    return swept(mappings.select("contig_id", "seq_id", "cstart", "cfinish"), ("contig_id",), ("cstart", "seq_id"), F.max, "cfinish", "reach").where("cstart > reach").drop("cfinish")


def islands(mappings: DataFrame) -> DataFrame:
    """contig_id, island (from 0), nreads, first_base, last_base: where a contig falls apart because nothing spans a hole."""
    order = ("cstart", "seq_id")
    at = swept(mappings.select("contig_id", "seq_id", "cstart", "cfinish"), ("contig_id",), order, F.max, "cfinish", "reach")
    at = swept(kept(at.withColumn("opens", F.coalesce(F.col("cstart") > F.col("reach"), F.lit(False)).cast("long"))), ("contig_id",), order, F.sum, "opens", "island", inclusive=True)
    return at.groupBy("contig_id", "island").agg(F.count("*").alias("nreads"), F.min("cstart").alias("first_base"), F.max("cfinish").alias("last_base"))


def collated(segments: DataFrame, repair: int = 0, keys=KEYS) -> DataFrame:
    """keys, part (from 1), x0, x1, y0, y1, dir: neighbouring segments joined where the gaps in x and y are equal and at most ``repair``."""
    line = W.partitionBy(*keys).orderBy("x0")
    last = lambda c: F.lag(c).over(line)
    x = F.col("x0") - last("x1") - 1
    y = F.when(F.col("dir") == 1, F.col("y0") - last("y1") - 1).otherwise(last("y0") - F.col("y1") - 1)
    fresh = last("x1").isNull() | (x != y) | (x > repair) | (last("dir") != F.col("dir"))
    at = segments.withColumn("fresh", fresh.cast("long")).withColumn("part", F.sum("fresh").over(line.rowsBetween(W.unboundedPreceding, 0)))
    return at.groupBy(*keys, "part").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.first("dir").alias("dir"))


def deduped_tags(tags: DataFrame, merge: bool = False, keys: tuple[str, ...] = ("contig_id", "tagtype")) -> DataFrame:
    """keys, cstart, cfinal, tags: equal tags once, with their number; with ``merge``, overlapping ones as one as well."""
    if not merge:
        return tags.groupBy(*keys, "cstart", "cfinal").agg(F.count("*").alias("tags"))
    order = ("cstart", "tag_id")
    at = swept(tags.select(*keys, "tag_id", "cstart", "cfinal"), keys, order, F.max, "cfinal", "reach")
    at = swept(kept(at.withColumn("opens", F.coalesce(F.col("cstart") > F.col("reach"), F.lit(False)).cast("long"))), keys, order, F.sum, "opens", "part", inclusive=True)
    return at.groupBy(*keys, "part").agg(F.min("cstart").alias("cstart"), F.max("cfinal").alias("cfinal"), F.count("*").alias("tags")).drop("part")
