"""Currency and placement of contigs and reads, with arguments.

Contigs: contig_id, project_id, created, nreads, length.  Edges: contig_id (child), parent_id.  Mappings: contig_id, seq_id, cstart,
cfinish, direction; ``placed`` are mappings of current contigs with project_id.  Rows with a null key meet nothing: such a read is free,
such a contig has no children.  Empty tables give no rows, except that every read is free without mappings.

``wanted`` (contig_id) limits a result of pairs to those of its contigs; None means all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def current(contigs: DataFrame, edges: DataFrame, more_reads_than: int = 0) -> DataFrame:
    """Contigs without children."""
    return contigs.where(F.col("nreads") > more_reads_than).join(edges.select(F.col("parent_id").alias("contig_id")), "contig_id", "left_anti")


def initial(contigs: DataFrame, edges: DataFrame) -> DataFrame:
    """Contigs without parents."""
    return contigs.join(edges.select("contig_id"), "contig_id", "left_anti")


def current_as_of(contigs: DataFrame, edges: DataFrame, day: str, more_reads_than: int = 1) -> DataFrame:
    """Contigs made before ``day`` that had no children, or one made after it."""
    day = F.lit(day).cast("date")
    later = contigs.select("contig_id", F.col("created").alias("born"))
    children = edges.join(later, "contig_id", "left").groupBy(F.col("parent_id").alias("contig_id")).agg(F.max("born").alias("last"))
    at = contigs.where((F.col("created") < day) & (F.col("nreads") > more_reads_than)).join(children.withColumn("parent", F.lit(True)), "contig_id", "left")
    return at.where(F.col("parent").isNull() | (F.col("last") > day)).select(contigs.columns)


def free_reads(reads: DataFrame, placed: DataFrame) -> DataFrame:
    """Reads that no mapping of ``placed`` uses."""
    return reads.join(placed.select(F.col("seq_id").alias("read_id")), "read_id", "left_anti")


def free_by_origin(reads: DataFrame, placed: DataFrame, templates: DataFrame, ligations: DataFrame) -> DataFrame:
    """clone_id, free_reads; reads without a known template or ligation are of no clone."""
    at = free_reads(reads, placed).join(templates.select("template_id", "ligation_id"), "template_id").join(ligations.select("ligation_id", "clone_id"), "ligation_id")
    return at.groupBy("clone_id").agg(F.count("*").alias("free_reads"))


def free_by_ligation(reads: DataFrame, placed: DataFrame, templates: DataFrame, ligations: DataFrame, complement: bool = False) -> DataFrame:
    """Free reads whose template is of one of ``ligations`` (ligation_id); with ``complement``, those of no one of them, reads of unknown ligation included."""
    of = templates.join(ligations.select("ligation_id").distinct(), "ligation_id", "left_semi").select("template_id")
    return free_reads(reads, placed).join(of, "template_id", "left_anti" if complement else "left_semi")


def free_as_of(reads: DataFrame, mappings: DataFrame, contigs: DataFrame, edges: DataFrame, day: str) -> DataFrame:
    """Reads that no contig current on ``day`` holds."""
    return free_reads(reads, mappings.join(current_as_of(contigs, edges, day).select("contig_id"), "contig_id", "left_semi"))


def placements(placed: DataFrame, reads: DataFrame, projects: DataFrame, project: str | None = None) -> DataFrame:
    """contig_id, project, readname, cstart, cfinish, direction; of one project if named."""
    named = projects.select("project_id", F.col("name").alias("project"))
    if project is not None:
        named = named.where(F.col("project") == project)
    return placed.join(named, "project_id").join(reads.select(F.col("read_id").alias("seq_id"), "readname"), "seq_id").select(
        "contig_id", "project", "readname", "cstart", "cfinish", "direction")


def current_contig(placed: DataFrame) -> DataFrame:
    """read_id, contig_id, project_id: the newest (highest) current contig of each read."""
    best = placed.groupBy(F.col("seq_id").alias("read_id")).agg(F.max(F.struct("contig_id", "project_id")).alias("b"))
    return best.select("read_id", "b.contig_id", "b.project_id")


def duplicates(placed: DataFrame) -> DataFrame:
    """seq_id, hits: reads in more than one mapping."""
    return placed.where("seq_id is not null").groupBy("seq_id").agg(F.count("*").alias("hits")).where("hits > 1")


def duplicate_placements(placed: DataFrame) -> DataFrame:
    """All mappings of duplicate reads."""
    return placed.join(duplicates(placed).select("seq_id"), "seq_id", "left_semi")


def in_several_contigs(placed: DataFrame) -> DataFrame:
    """seq_id, contigs: reads in more than one contig."""
    return placed.where("seq_id is not null").groupBy("seq_id").agg(F.count_distinct("contig_id").alias("contigs")).where("contigs > 1")


def met(one: DataFrame, two: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Pairs of mappings of a read in two contigs: columns of ``one`` (a_) and ``two`` (b_) and seq_id."""
    if wanted is not None:
        one = one.join(wanted.select("contig_id"), "contig_id", "left_semi")
    side = lambda df, x: df.select("seq_id", *(F.col(c).alias(f"{x}_{c}") for c in df.columns if c != "seq_id"))
    return side(one, "a").join(side(two, "b"), "seq_id").where("a_contig_id <> b_contig_id")


def shared_segments(mappings: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """contig_a, contig_b, seq_id and both intervals of reads that two contigs share.

    Without ``wanted`` each pair once (a < b); with it, a is a wanted contig and b any other.
    """
    at = met(*[mappings.select("contig_id", "seq_id", "cstart", "cfinish")] * 2, wanted)
    at = at if wanted is not None else at.where("a_contig_id < b_contig_id")
    return at.select(F.col("a_contig_id").alias("contig_a"), F.col("b_contig_id").alias("contig_b"), "seq_id", F.col("a_cstart").alias("start_a"),
                     F.col("a_cfinish").alias("finish_a"), F.col("b_cstart").alias("start_b"), F.col("b_cfinish").alias("finish_b"))


def sharing_pairs(mappings: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """contig_a, contig_b, shared: pairs of contigs with their number of shared reads."""
    return shared_segments(mappings, wanted).groupBy("contig_a", "contig_b").agg(F.count("*").alias("shared"))


def allocation(placed: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """seq_id, contig_a, contig_b, kind: reads in two contigs, inside one project or between two."""
    at = met(*[placed.select("contig_id", "seq_id", "project_id")] * 2, wanted)
    at = at if wanted is not None else at.where("a_contig_id < b_contig_id")
    kind = F.when(F.col("a_project_id") == F.col("b_project_id"), "inside").otherwise("between")
    return at.select("seq_id", F.col("a_contig_id").alias("contig_a"), F.col("b_contig_id").alias("contig_b"), kind.alias("kind"))


def family(mappings: DataFrame, wanted: DataFrame | None = None, kind: str | None = None) -> DataFrame:
    """contig_id, relative, kind: contigs that share reads; lower ids are ancestors, higher ones descendants; of one ``kind`` if given."""
    at = met(*[mappings.select("contig_id", "seq_id")] * 2, wanted)
    which = F.when(F.col("b_contig_id") < F.col("a_contig_id"), "ancestor").otherwise("descendant")
    found = at.select(F.col("a_contig_id").alias("contig_id"), F.col("b_contig_id").alias("relative"), which.alias("kind"))
    return (found if kind is None else found.where(F.col("kind") == kind)).distinct()


def current_for_ancestors(placed: DataFrame, mappings: DataFrame, edges: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """current_id, ancestor_id: current contigs that hold reads of a parent contig; of ``wanted`` ancestors only if given."""
    parents = edges.select(F.col("parent_id").alias("contig_id"))
    old = mappings.select("contig_id", "seq_id").join(parents, "contig_id", "left_semi")
    at = met(old, placed.select("contig_id", "seq_id"), wanted)
    return at.select(F.col("b_contig_id").alias("current_id"), F.col("a_contig_id").alias("ancestor_id")).distinct()


def template_spans(placed: DataFrame) -> DataFrame:
    """contig_id, template_id, excess, kind: neighbouring reads of a template on a contig; excess is their span over the insert size.

    Forward followed by Reverse is consistent, any other order inconsistent.
    """
    line = W.partitionBy("contig_id", "template_id").orderBy("cstart", "seq_id")
    at = placed.select("contig_id", "template_id", "strand", "cfinish", "sihigh", F.lag("strand").over(line).alias("before"), F.lag("cstart").over(line).alias("start"))
    good = (F.col("before") == "Forward") & (F.col("strand") == "Reverse")
    return at.where("before is not null").select("contig_id", "template_id", (F.col("cfinish") - F.col("start") + 1 - F.col("sihigh")).alias("excess"),
                                                 F.when(good, "consistent").otherwise("inconsistent").alias("kind"))


def clip_excess(extents: DataFrame, clips: DataFrame) -> DataFrame:
    """side, reads, most, mean, sd: how far used ranges (rmin, rmax) of reads reach beyond their quality clip (qleft, qright)."""
    at = extents.select("seq_id", "rmin", "rmax").join(clips.select("seq_id", "qleft", "qright"), "seq_id")
    over = F.inline(F.array(F.struct(F.lit("left").alias("side"), (F.col("qleft") - F.col("rmin")).alias("by")), F.struct(F.lit("right").alias("side"), (F.col("rmax") - F.col("qright")).alias("by"))))
    return at.select(over).where("by > 0").groupBy("side").agg(F.count("*").alias("reads"), F.max("by").alias("most"), F.avg("by").alias("mean"), F.stddev_pop("by").alias("sd"))


def end_reads(mappings: DataFrame, contigs: DataFrame) -> DataFrame:
    """contig_id, left_read, right_read: the lowest read id that starts first and the lowest that reaches the contig's length."""
    ends = mappings.groupBy("contig_id").agg(F.min(F.struct("cstart", "seq_id")).alias("l"), F.min(F.struct((-F.col("cfinish")).alias("f"), "seq_id")).alias("r"))
    at = ends.join(contigs.select("contig_id", "length"), "contig_id")
    return at.select("contig_id", F.col("l.seq_id").alias("left_read"), F.when(-F.col("r.f") == F.col("length"), F.col("r.seq_id")).alias("right_read"))


def single_read_parents(edges: DataFrame, contigs: DataFrame) -> DataFrame:
    """contig_id, parent_id: single-read parents of contigs of several reads."""
    many = contigs.where("nreads > 1").select("contig_id")
    single = contigs.where("nreads = 1").select(F.col("contig_id").alias("parent_id"))
    return edges.select("contig_id", "parent_id").join(single, "parent_id").join(many, "contig_id").select("contig_id", "parent_id")


def unlisted_segments(segments: DataFrame, kept: DataFrame) -> DataFrame:
    """contig_id, seq_id, segments of contigs that a clean-up which keeps ``kept`` would remove."""
    return segments.join(kept.select("contig_id"), "contig_id", "left_anti").groupBy("contig_id", "seq_id").agg(F.count("*").alias("segments"))
