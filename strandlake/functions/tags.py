"""Tags: intervals (tag_id, contig_id, tagtype, cstart, cfinal, strand and more) on contigs or reads."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.functions.lineage import relations
from strandlake.functions.mappings import binned, first_bin
from strandlake.operators.components import settled

#: Types that may be split when they are carried to a child; all others are of finishing.
ANNOTATION = ("FCDS", "CDS")


def remapped(tags: DataFrame, links: DataFrame, before: int = 0, after: int = 0) -> DataFrame:
    """Tags of parents on their children, through every segment of the link that they meet.

    ``links``: contig_id, parent_id, dir, shift, cstart, cfinish (on the child).  Adds pieces, frame_shifts (pieces - 1), left_cut and
    right_cut (the tag reaches beyond what is linked, in the parent's direction); the strand turns with the direction.  ``before`` and
    ``after`` widen the tag first.
    """
    turned = F.col("dir") == -1
    a = F.when(turned, F.col("shift") - F.col("cfinish")).otherwise(F.col("cstart") - F.col("shift"))
    b = F.when(turned, F.col("shift") - F.col("cstart")).otherwise(F.col("cfinish") - F.col("shift"))
    on_parent = links.select("contig_id", "parent_id", "dir", "shift", a.alias("p0"), b.alias("p1"))
    wide = tags.withColumnRenamed("contig_id", "parent_id").withColumns({"t0": F.col("cstart") - before, "t1": F.col("cfinal") + after})
    met = binned(wide, "t0", "t1").join(binned(on_parent, "p0", "p1"), ["parent_id", "bin"]).where((F.col("t0") <= F.col("p1")) & (F.col("p0") <= F.col("t1")) & first_bin("t0", "p0"))
    low, high = F.greatest("t0", "p0"), F.least("t1", "p1")
    at = met.withColumns({"low": low, "high": high})
    at = at.withColumns({"c0": F.when(turned, F.col("shift") - F.col("high")).otherwise(F.col("low") + F.col("shift")),
                         "c1": F.when(turned, F.col("shift") - F.col("low")).otherwise(F.col("high") + F.col("shift"))})
    rest = [c for c in tags.columns if c not in ("contig_id", "cstart", "cfinal", "strand", "tag_id")]
    whole = at.groupBy("tag_id", "contig_id", "parent_id", "strand", "t0", "t1", *rest).agg(
        F.min("c0").alias("cstart"), F.max("c1").alias("cfinal"), F.min("dir").alias("dir"), F.count("*").alias("pieces"), F.min("low").alias("low"), F.max("high").alias("high"))
    strand = F.when(F.col("dir") == 1, F.col("strand")).when(F.col("strand") == "F", "C").when(F.col("strand") == "C", "F").otherwise(F.col("strand"))
    return whole.select("tag_id", "contig_id", "parent_id", *rest, "cstart", "cfinal", strand.alias("strand"), "pieces", (F.col("pieces") - 1).alias("frame_shifts"),
                        (F.col("low") > F.col("t0")).alias("left_cut"), (F.col("high") < F.col("t1")).alias("right_cut"))


def propagated(tags: DataFrame, links: DataFrame, generations: int = 2, annotation=ANNOTATION) -> DataFrame:
    """generation and the carried tags: annotation may come in pieces; a finishing tag that is cut or in pieces becomes ASIT."""
    now, out = tags, None
    for g in range(1, generations + 1):
        moved = remapped(now, links)
        hurt = (F.col("pieces") > 1) | F.col("left_cut") | F.col("right_cut")
        kind = F.when(hurt & ~F.col("tagtype").isin(list(annotation)), "ASIT").otherwise(F.col("tagtype"))
        now = moved.withColumn("tagtype", kind).select(tags.columns).distinct()
        one = now.withColumn("generation", F.lit(g))
        out = one if out is None else out.unionByName(one)
    return out


def transposed(tags: DataFrame, align: int, offset: Column | int) -> DataFrame:
    """Shifted by ``offset``, or, with align -1, mirrored about it (offset - position) with the strand turned."""
    if align == 1:
        return tags.withColumns({"cstart": F.col("cstart") + offset, "cfinal": F.col("cfinal") + offset})
    strand = F.when(F.col("strand") == "F", "C").when(F.col("strand") == "C", "F").otherwise(F.col("strand"))
    return tags.withColumns({"cstart": offset - F.col("cfinal"), "cfinal": offset - F.col("cstart"), "strand": strand})


def composite(tags: DataFrame, keys=("contig_id", "tagtype")) -> DataFrame:
    """Keys, cstart, cfinal, ranges: tags of equal keys as one tag of several ranges (array of structs in order)."""
    at = tags.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("cstart", "cfinal"))).alias("ranges"))
    return at.select(*keys, F.array_min(F.col("ranges")["cstart"]).alias("cstart"), F.array_max(F.col("ranges")["cfinal"]).alias("cfinal"), "ranges")


def split(composites: DataFrame, sequences: DataFrame | None = None) -> DataFrame:
    """One row per range, numbered; with sequences (contig_id, dna), ``fragment`` is what stands below it."""
    rest = [c for c in composites.columns if c not in ("cstart", "cfinal", "ranges")]
    each = composites.select(*rest, F.posexplode("ranges").alias("k", "r")).select(*rest, (F.col("k") + 1).alias("part"), "r.cstart", "r.cfinal")
    if sequences is None:
        return each
    at = each.join(sequences.select("contig_id", "dna"), "contig_id", "left")
    return at.select(*each.columns, F.substring("dna", F.col("cstart").cast("int"), (F.col("cfinal") - F.col("cstart") + 1).cast("int")).alias("fragment"))


def collapsed(parts: DataFrame, keys=("contig_id", "tagtype")) -> DataFrame:
    """Keys, cstart, cfinal, parts, and, if the parts have fragments, their sequence with gaps as X (overlaps give no gap)."""
    aggregates = [F.min("cstart").alias("cstart"), F.max("cfinal").alias("cfinal"), F.count("*").alias("parts")]
    if "fragment" in parts.columns:
        last = F.lag("cfinal").over(W.partitionBy(*keys).orderBy("part"))
        parts = parts.withColumn("gap", F.greatest(F.coalesce(F.col("cstart") - last - 1, F.lit(0)), F.lit(0)))
        piece = F.struct("part", F.concat(F.repeat(F.lit("X"), F.col("gap").cast("int")), F.coalesce("fragment", F.lit(""))).alias("p"))
        aggregates.append(F.array_join(F.array_sort(F.collect_list(piece))["p"], "").alias("sequence"))
    return parts.groupBy(*keys).agg(*aggregates)


def merged(tags: DataFrame, keys=("contig_id", "tagtype", "sysid", "strand"), exclude=(), adjoining: bool = True) -> DataFrame:
    """Overlapping (and adjoining) tags of equal keys become one; null keys are values like others; excluded types stay single."""
    line = W.partitionBy(*keys).orderBy("cstart", "tag_id")
    reach = F.max("cfinal").over(line.rowsBetween(W.unboundedPreceding, -1))
    fresh = F.col("reach").isNull() | (F.col("cstart") > F.col("reach") + (1 if adjoining else 0))
    if exclude:
        fresh |= F.col("tagtype").isin(list(exclude))
    at = tags.withColumn("reach", reach).withColumn("fresh", fresh.cast("int")).withColumn("part", F.sum("fresh").over(line))
    return at.groupBy(*keys, "part").agg(F.min("cstart").alias("cstart"), F.max("cfinal").alias("cfinal"), F.count("*").alias("tags")).drop("part")


def related(one: DataFrame, two: DataFrame) -> DataFrame:
    """tag_a, tag_b, kind for tags of a contig: equal, contains, contained, overlaps or adjoins."""
    side = lambda df, n: df.select("contig_id", F.col("tag_id").alias(f"tag_{n}"), F.col("cstart").alias(f"{n}0"), F.col("cfinal").alias(f"{n}1"), (F.col("cfinal") + 1).alias(f"{n}2"))
    met = binned(side(one, "a"), "a0", "a2").join(binned(side(two, "b"), "b0", "b2"), ["contig_id", "bin"]).where("a0 <= b2 and b0 <= a2")
    met = met.where(first_bin("a0", "b0"))
    kind = (F.when((F.col("a0") == F.col("b0")) & (F.col("a1") == F.col("b1")), "equal").when((F.col("a0") > F.col("b1")) | (F.col("b0") > F.col("a1")), "adjoins")
            .when((F.col("a0") <= F.col("b0")) & (F.col("a1") >= F.col("b1")), "contains").when((F.col("b0") <= F.col("a0")) & (F.col("b1") >= F.col("a1")), "contained").otherwise("overlaps"))
    return met.select("contig_id", "tag_a", "tag_b", kind.alias("kind"))


def lineage(tags: DataFrame) -> DataFrame:
    """tag_id, relative, generations of all precursors (tag_id, parent_tag_id), descendants negative."""
    one = settled(tags.select("tag_id", F.col("parent_tag_id").alias("parent")).na.drop().distinct())
    if one.groupBy("tag_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return descents(rooted(one))
    up = relations(one.select(F.col("tag_id").alias("contig_id"), F.col("parent").alias("parent_id"))).select(F.col("contig_id").alias("tag_id"), "relative", F.col("gen_min").alias("generations"))
    return up.unionByName(up.select(F.col("relative").alias("tag_id"), F.col("tag_id").alias("relative"), (-F.col("generations")).alias("generations")))


def rooted(one: DataFrame) -> DataFrame:
    """tag_id, parent, root (the first of all precursors) of tags of one precursor each, by doubling: a row a tag, whatever the length of its line."""
    at, rounds = settled(one.withColumn("root", F.col("parent"))), one.count().bit_length() + 1
    while True:
        far = at.select(F.col("tag_id").alias("root"), F.col("root").alias("beyond"))
        moved = at.join(far, "root", "left")
        if moved.where("beyond is not null").isEmpty():
            return at
        if not rounds:
            raise ValueError("the lineage has a cycle")
        rounds -= 1
        at = settled(moved.select("tag_id", "parent", F.coalesce("beyond", "root").alias("root")))


def descents(at: DataFrame, nodes: int = 20_000, rows: int = 100_000) -> DataFrame:
    """``lineage`` of what ``rooted`` gives.  Pairs are made from whole trees inside of tasks and handed on some ``rows`` at a time: none is shuffled, written or held."""
    kind = at.schema["tag_id"].dataType.simpleString()

    def solved(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tag, parent = (np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in held]) for k in (0, 1))
        order = np.argsort(tag)
        ids = tag[order]
        place = np.minimum(np.searchsorted(ids, parent), len(ids) - 1)
        above = np.where(ids[place] == parent, order[place], -1)  # the row of the precursor, if it has one itself
        at_, steps, out, many = np.arange(len(tag)), 1, [], 0
        low = at_
        while len(low):
            out.append((tag[low], parent[at_], np.full(len(low), steps, np.int32)))
            many += len(low)
            up = above[at_]
            low, at_, steps = low[up >= 0], up[up >= 0], steps + 1
            if many >= rows or not len(low):
                one, other, n = (np.concatenate(c) for c in zip(*out))
                for part in range(0, len(one), rows):
                    x, y, k = (v[part : part + rows] for v in (one, other, n))
                    yield pa.RecordBatch.from_arrays([pa.array(np.append(x, y)), pa.array(np.append(y, x)), pa.array(np.append(k, -k))], names=["tag_id", "relative", "generations"])
                out, many = [], 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            root = batch.column(2).to_numpy(zero_copy_only=False)
            starts = np.append(0, np.flatnonzero(root[1:] != root[:-1]) + 1)
            begin = 0
            for start in starts:  # a tree begins here
                size_here = size + start - begin
                if size_here >= nodes and (start > 0 or held[-1].column(2)[-1].as_py() != root[0]):
                    held += [batch.slice(begin, start - begin)] if start > begin else []
                    yield from solved(held)
                    held, size, begin = [], 0, int(start)
            held.append(batch.slice(begin))
            size += batch.num_rows - begin
        if size:
            yield from solved(held)

    return at.select("tag_id", "parent", "root").repartition("root").sortWithinPartitions("root").mapInArrow(run, f"tag_id {kind}, relative {kind}, generations int")


def cleaned(tags: DataFrame) -> DataFrame:
    """Tags with their content in order, and ``problem`` (null if none).

    Types are trimmed and upper-cased; comments lose quotes, escaped line ends and doubled blanks.  A repeat tag (REPT) needs a name: the
    word after ``Repeats with`` or the first word.  ADDI tags start at 1.  Oligo tags (OLIG) need a sequence in their comment (``sequence = ...``), and
    a sysid, which defaults to ``o`` and the tag's id.  Positions below 1 are raised to 1; a tag that ends before it starts is a problem.
    """
    comment = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce("comment", F.lit("")), r"\\n", " "), '["]', ""), r"\s+", " "))
    at = tags.withColumns({"tagtype": F.upper(F.trim("tagtype")), "comment": comment})
    name = F.coalesce(F.nullif(F.regexp_extract("comment", r"(?i)repeats? with (\S+)", 1), F.lit("")), F.nullif(F.regexp_extract("comment", r"^(\S+)", 1), F.lit("")))
    oligo = F.nullif(F.upper(F.regexp_extract("comment", r"(?i)sequence\s*=\s*([ACGTN]+)", 1)), F.lit(""))
    is_type = lambda t: F.col("tagtype") == t
    at = at.withColumns({"name": F.when(is_type("REPT"), name), "oligo": F.when(is_type("OLIG"), oligo), "cstart": F.when(is_type("ADDI"), 1).otherwise(F.greatest("cstart", F.lit(1)))})
    at = at.withColumn("sysid", F.coalesce("sysid", F.when(is_type("OLIG"), F.concat(F.lit("o"), F.col("tag_id").cast("string")))))
    problem = F.when(F.col("cfinal") < F.col("cstart"), "ends before it starts").when(is_type("REPT") & F.col("name").isNull(), "repeat without name").when(is_type("OLIG") & F.col("oligo").isNull(), "oligo without sequence")
    return at.withColumn("problem", problem)


IDENTITY = ("contig_id", "tagtype", "cstart", "cfinal", "comment")


def new_tags(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Incoming tags that are not stored yet, by ``IDENTITY`` (null comments are equal); of equal incoming ones the lowest id."""
    first = incoming.groupBy(*IDENTITY).agg(F.min("tag_id").alias("tag_id"))
    same = [F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}")) for c in IDENTITY]
    return first.alias("n").join(stored.select(*IDENTITY).alias("o"), same, "left_anti").select("tag_id", *IDENTITY)


def dictionary(tags: DataFrame, stored: DataFrame) -> DataFrame:
    """name, oligo, is_new: every tag sequence once, with whether ``stored`` (name, oligo) lacks it."""
    all_of = tags.where("oligo is not null").select("sysid", "oligo").groupBy("oligo").agg(F.min("sysid").alias("name"))
    return all_of.join(stored.select("oligo", F.lit(False).alias("is_new")), "oligo", "left").select("name", "oligo", F.coalesce("is_new", F.lit(True)).alias("is_new"))


def repeat_tags(matches: DataFrame, clips: DataFrame, dictionary: DataFrame, tagtype: str = "REPT") -> DataFrame:
    """Tags of reads from repeat matches (one: the read, one_first, one_last, turned, two: the repeat's name).

    Positions are those of the clipped read, so the left clip is added; reads without a clip start at 0.  Names that ``dictionary``
    (name, title) doesn't know keep their own as title.
    """
    at = matches.join(clips.select(F.col("readname").alias("one"), "qleft"), "one", "left").join(dictionary.select(F.col("name").alias("two"), "title"), "two", "left")
    shift = F.coalesce("qleft", F.lit(0))
    return at.select(F.col("one").alias("readname"), F.lit(tagtype).alias("tagtype"), (F.col("one_first") + shift).alias("first"), (F.col("one_last") + shift).alias("last"),
                     F.when(F.col("turned"), "R").otherwise("F").alias("strand"), F.coalesce("title", "two").alias("comment"))
