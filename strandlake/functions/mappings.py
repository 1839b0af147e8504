"""Interval mapping algebra: segments (keys, x0, x1, y0, y1, dir) with x0 <= x1, y0 <= y1 and dir 1 or -1.

Keys are contig_id and seq_id unless given.  A segment maps x to y by y = y0 + x - x0, or y = y1 - (x - x0) if dir is -1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEYS = ("contig_id", "seq_id")
#: Positions of a bin of interval joins.
BIN = 1000


def offset() -> Column:
    """x = dir * y + offset, the same for all points of a segment."""
    return F.when(F.col("dir") == 1, F.col("x0") - F.col("y0")).otherwise(F.col("x0") + F.col("y1"))


def from_ends(rows: DataFrame, keys=KEYS) -> DataFrame:
    """Segments from ends as written (x_first, x_last, y_first, y_last), in either direction.

    Either end may be the larger.  A segment of one base has no direction of its own and takes that of the mapping's most bases
    (forward if tied), as the whole mapping does: one mapping has one direction.
    """
    x, y = F.col("x_last") - F.col("x_first"), F.col("y_last") - F.col("y_first")
    lean = F.when(x * y < 0, -F.abs(x)).otherwise(F.abs(x))
    way = F.when(F.sum(lean).over(W.partitionBy(*keys)) < 0, -1).otherwise(1)
    low, high = (lambda a, b: F.least(a, b)), (lambda a, b: F.greatest(a, b))
    return rows.select(*keys, low("x_first", "x_last").alias("x0"), high("x_first", "x_last").alias("x1"), low("y_first", "y_last").alias("y0"),
                       high("y_first", "y_last").alias("y1"), way.alias("dir"))


def normalised(segments: DataFrame, keys=KEYS, by: str = "x") -> DataFrame:
    """keys, dir, x0, x1, y0, y1 of the whole mapping, its number of segments and whether they are regular."""
    checked = regular(segments, keys)
    at = segments.groupBy(*keys).agg(F.first("dir").alias("dir"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"),
                                     F.max("y1").alias("y1"), F.count("*").alias("segments"))
    return at.join(checked, list(keys))


def regular(segments: DataFrame, keys=KEYS) -> DataFrame:
    """keys, reason: why a mapping isn't regular (mixed directions, x or y overlap, y order), or ``regular``."""
    line = W.partitionBy(*keys).orderBy("x0", "x1", "y0")
    last = lambda c: F.lag(c).over(line)
    forward = F.col("dir") == 1
    fault = (
        F.when(last("dir") != F.col("dir"), 3).when(F.col("x0") <= last("x1"), 2)
        .when(F.when(forward, F.col("y0") <= last("y1")).otherwise(F.col("y1") >= last("y0")), 1).otherwise(0)
    )
    worst = segments.withColumn("fault", fault).groupBy(*keys).agg(F.max("fault").alias("f"))
    names = F.when(F.col("f") == 3, "mixed directions").when(F.col("f") == 2, "x overlaps").when(F.col("f") == 1, "y out of order").otherwise("regular")
    return worst.select(*keys, names.alias("reason"))


def shifted(segments: DataFrame, by: Column | int) -> DataFrame:
    return segments.withColumn("x0", F.col("x0") + by).withColumn("x1", F.col("x1") + by)


def mirrored(segments: DataFrame, about: Column | int) -> DataFrame:
    """x -> about - x."""
    return segments.withColumns({"x0": about - F.col("x1"), "x1": about - F.col("x0"), "dir": -F.col("dir")})


def inverse(segments: DataFrame) -> DataFrame:
    return segments.withColumns({"x0": F.col("y0"), "x1": F.col("y1"), "y0": F.col("x0"), "y1": F.col("x1")})


def binned(rows: DataFrame, low: str, high: str, size: int = BIN) -> DataFrame:
    """Rows once for each bin they touch, for equi joins on the bin; see ``first_bin``."""
    return rows.withColumn("bin", F.explode(F.sequence(F.floor(F.col(low) / size), F.floor(F.col(high) / size))))


def first_bin(low_a: str, low_b: str, size: int = BIN) -> Column:
    """True in the first bin that two meeting intervals share, so that each pair is met once."""
    return F.col("bin") == F.floor(F.greatest(low_a, low_b) / size)


def transformed(segments: DataFrame, first: Column | int, last: Column | int) -> DataFrame:
    """keys, dir, y_first, y_last: the images of x positions ``first``..``last``."""
    first, last = (v if isinstance(v, Column) else F.lit(v) for v in (first, last))
    a, b = F.greatest("x0", first), F.least("x1", last)
    forward = F.col("dir") == 1
    return segments.where((F.col("x0") <= last) & (F.col("x1") >= first)).withColumns({
        "y_first": F.when(forward, F.col("y0") + a - F.col("x0")).otherwise(F.col("y1") - (b - F.col("x0"))),
        "y_last": F.when(forward, F.col("y0") + b - F.col("x0")).otherwise(F.col("y1") - (a - F.col("x0"))),
    }).drop("x0", "x1", "y0", "y1")


def joined(segments: DataFrame, keys=KEYS, gap: int = 0) -> DataFrame:
    """Neighbours of one offset and direction that touch (or lie up to ``gap`` apart) become one segment."""
    line = W.partitionBy(*keys, "dir", "shift").orderBy("x0", "x1")
    at = segments.withColumn("shift", offset()).withColumn("reach", F.max("x1").over(line.rowsBetween(W.unboundedPreceding, -1)))
    part = F.sum((F.col("reach").isNull() | (F.col("x0") > F.col("reach") + 1 + gap)).cast("int")).over(line)
    return at.withColumn("part", part).groupBy(*keys, "dir", "shift", "part").agg(
        F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.count("*").alias("parts")).drop("part")


def extended(segments: DataFrame, first: Column | int, last: Column | int, keys=KEYS) -> DataFrame:
    """The first and last segment of each mapping stretched to fill x ``first``..``last``, y with it."""
    first, last = (v if isinstance(v, Column) else F.lit(v) for v in (first, last))
    whole = W.partitionBy(*keys)
    at = segments.withColumn("lead", F.when(F.col("x0") == F.min("x0").over(whole), F.greatest(F.col("x0") - first, F.lit(0))).otherwise(0))
    at = at.withColumn("trail", F.when(F.col("x1") == F.max("x1").over(whole), F.greatest(last - F.col("x1"), F.lit(0))).otherwise(0))
    forward = F.col("dir") == 1
    return at.withColumns({
        "x0": F.col("x0") - F.col("lead"), "x1": F.col("x1") + F.col("trail"), "y0": F.col("y0") - F.when(forward, F.col("lead")).otherwise(F.col("trail")),
        "y1": F.col("y1") + F.when(forward, F.col("trail")).otherwise(F.col("lead")),
    }).drop("lead", "trail")


def lifted(segments: DataFrame, positions: DataFrame, key: str = "contig_id", size: int = BIN) -> DataFrame:
    """``positions`` (key, pos, ...) with the segment's other columns and ``y``; positions outside all segments go."""
    other = positions.withColumn("bin", F.floor(F.col("pos") / size))
    met = binned(segments, "x0", "x1", size).join(other, [key, "bin"]).where((F.col("pos") >= F.col("x0")) & (F.col("pos") <= F.col("x1")))
    y = F.when(F.col("dir") == 1, F.col("y0") + F.col("pos") - F.col("x0")).otherwise(F.col("y1") - (F.col("pos") - F.col("x0")))
    return met.withColumn("y", y).drop("bin")


def equal(one: DataFrame, two: DataFrame, keys=KEYS, by: str = "seq_id") -> DataFrame:
    """Pairs of mappings of one ``by`` with the same segments up to direction and shift of x: keys, keys with _2, aligned, shift.

    A mapping's shape is its segments relative to its first base, read in either direction; equal shapes are joined as digests.
    """
    def shapes(segments: DataFrame) -> DataFrame:
        whole = W.partitionBy(*keys)
        low, high = F.min("x0").over(whole), F.max("x1").over(whole)
        at = segments.withColumns({"a": F.col("x0") - low, "b": high - F.col("x1"), "low": low, "high": high, "size": F.col("x1") - F.col("x0")})
        shape = lambda start, way: F.md5(F.to_json(F.array_sort(F.collect_list(F.struct(F.col(start).alias("at"), F.col("size"), F.col("y0"), (F.col("dir") * way).alias("d"))))))
        return at.groupBy(*keys).agg(F.min("low").alias("low"), F.max("high").alias("high"), shape("a", 1).alias("plain"), shape("b", -1).alias("turned"))

    a = shapes(one).select(*keys, "low", "high", F.col("plain").alias("shape"))
    b = shapes(two)
    both = b.select(*(F.col(k).alias(f"{k}_2") for k in keys), F.col("low").alias("low_2"), F.col("high").alias("high_2"),
                    F.inline(F.array(F.struct(F.col("plain").alias("shape"), F.lit(1).alias("aligned")), F.struct(F.col("turned").alias("shape"), F.lit(-1).alias("aligned")))))
    met = a.join(both, (F.col(by) == F.col(f"{by}_2")) & (a["shape"] == both["shape"]))
    shift = F.when(F.col("aligned") == 1, F.col("low_2") - F.col("low")).otherwise(F.col("high_2") + F.col("low"))
    return met.select(*keys, *(f"{k}_2" for k in keys), "aligned", shift.alias("shift"))


def multiplied(one: DataFrame, two: DataFrame, on: str = "seq_id", size: int = BIN) -> DataFrame:
    """Composition over a common y: segments from the x of ``one`` to the x of ``two`` (as y0, y1); keys contig_id and contig_2."""
    other = two.select(on, F.col("contig_id").alias("contig_2"), *(F.col(c).alias(f"{c}_2") for c in ("x0", "x1", "y0", "y1", "dir")))
    met = binned(one, "y0", "y1", size).join(binned(other, "y0_2", "y1_2", size), [on, "bin"])
    met = met.where((F.col("y0") <= F.col("y1_2")) & (F.col("y0_2") <= F.col("y1")) & first_bin("y0", "y0_2", size))
    a, b = F.greatest("y0", "y0_2"), F.least("y1", "y1_2")
    x = lambda way, x0, x1, y0: (F.when(F.col(way) == 1, F.col(x0) + a - F.col(y0)).otherwise(F.col(x1) - (b - F.col(y0))),
                                 F.when(F.col(way) == 1, F.col(x0) + b - F.col(y0)).otherwise(F.col(x1) - (a - F.col(y0))))
    (p, q), (r, s) = x("dir", "x0", "x1", "y0"), x("dir_2", "x0_2", "x1_2", "y0_2")
    return met.select("contig_id", "contig_2", on, p.alias("x0"), q.alias("x1"), r.alias("y0"), s.alias("y1"), (F.col("dir") * F.col("dir_2")).alias("dir"))


def traced(read_segments: DataFrame, edits: DataFrame) -> DataFrame:
    """Alignment of reads to their traces through the edits: ``edits`` (seq_id, x0, x1, y0, y1, dir) map edited to trace positions.

    contig_id, seq_id, x0, x1 (contig), y0, y1 (trace), dir, edited: whether the read's alignment to its trace has more than one record.
    """
    back = inverse(edits).withColumn("contig_id", F.col("seq_id"))
    carried = multiplied(read_segments, back).drop("contig_2")
    many = edits.groupBy("seq_id").agg((F.count("*") > 1).alias("edited"))
    return carried.join(many, "seq_id")


def extents(segments: DataFrame, *keys: str) -> DataFrame:
    """keys, xmin, xmax, ymin, ymax of all their segments."""
    return segments.groupBy(*keys).agg(F.min("x0").alias("xmin"), F.max("x1").alias("xmax"), F.min("y0").alias("ymin"), F.max("y1").alias("ymax"))


def parts(segments: DataFrame, keys=KEYS) -> DataFrame:
    """Every segment as a mapping of its own: adds part, from 1 in order of x."""
    return segments.withColumn("part", F.row_number().over(W.partitionBy(*keys).orderBy("x0")))


def compared(one: DataFrame, two: DataFrame, pairs: DataFrame) -> DataFrame:
    """contig_id, parent_id, seq_id, align, shift, y_first, y_last, pieces: what maps the parent's positions of a shared read to the child's.

    ``one`` and ``two`` are segments of children and parents, ``pairs`` their contig_id and parent_id.  Where both mappings use a read's
    bases, child = align * parent + shift; a mapping whose segments disagree has a row for each shift and alignment.
    """
    child = one.select("contig_id", "seq_id", F.col("dir").alias("d"), offset().alias("o"), F.col("y0").alias("a0"), F.col("y1").alias("a1"))
    parent = two.select(F.col("contig_id").alias("parent_id"), "seq_id", F.col("dir").alias("pd"), offset().alias("po"), F.col("y0").alias("b0"), F.col("y1").alias("b1"))
    met = child.join(pairs.select("contig_id", "parent_id"), "contig_id").join(parent, ["parent_id", "seq_id"]).where("b0 <= a1 and b1 >= a0")
    align = F.col("d") * F.col("pd")
    return met.groupBy("contig_id", "parent_id", "seq_id", align.alias("align"), (F.col("o") - align * F.col("po")).alias("shift")).agg(
        F.min(F.greatest("a0", "b0")).alias("y_first"), F.max(F.least("a1", "b1")).alias("y_last"), F.count("*").alias("pieces"))


def complemented(strings: DataFrame, column: str = "dna") -> DataFrame:
    """Adds ``turned``, the reverse complement."""
    from strandlake.functions.sequences import reverse_complement

    return strings.withColumn("turned", reverse_complement(column))


def along(parts: str, column: str = "dna", gap: str = "-") -> Column:
    """The string carried over a mapping's segments, the column ``parts`` (array of x0, x1, y0, y1, dir, in order), from it and its reverse
    complement ``turned``.

    A part of a reverse segment is one of the complement of the whole, so no part is complemented again.  ``parts`` is a column and no
    expression, which Spark would compute again for every segment.
    """
    size, line = F.length(column), F.col(parts)

    def piece(part: Column, i: Column) -> Column:
        y1 = F.least(part["y1"], size)
        n = F.greatest(y1 - part["y0"] + 1, F.lit(0)).cast("int")
        hole = F.when(i > 0, F.greatest(part["x0"] - F.get(line, i - 1)["x1"] - 1, F.lit(0))).otherwise(0).cast("int")
        text = F.when(part["dir"] == 1, F.col(column).substr(part["y0"].cast("int"), n)).otherwise(F.col("turned").substr((size - y1 + 1).cast("int"), n))
        return F.concat(F.repeat(F.lit(gap), hole), text)

    return F.array_join(F.transform(line, piece), "")


def carried(segments: DataFrame, strings: DataFrame, column: str = "dna", gap: str = "-", keys=KEYS) -> DataFrame:
    """keys, carried: ``strings`` (seq_id, column) carried from y to x, complemented on reverse segments, ``gap`` in the holes between.

    The segments of a mapping come together before they meet the string, which travels once a mapping.
    """
    whole = segments.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("x0", "x1", "y0", "y1", "dir"))).alias("parts"))
    return whole.join(complemented(strings.select("seq_id", column), column), "seq_id").select(*keys, along("parts", column, gap).alias("carried"))
