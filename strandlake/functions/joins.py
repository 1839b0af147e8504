"""Joins over reads, templates and placements, with arguments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions.mappings import binned, first_bin


def conflicts(incoming: DataFrame, placed: DataFrame, project: str) -> DataFrame:
    """readname, project of incoming reads that are placed in another project, by name without regard to case."""
    return incoming.select("readname").join(placed, "readname").where(F.upper("project") != project.upper()).select("readname", "project").distinct()


def siblings(reads: DataFrame, placed: DataFrame, project_id: int, both: bool = True, unlike: str | None = None) -> DataFrame:
    """Unplaced PASS reads of templates that a project uses; only of strands it lacks there unless ``both``; minus a name pattern (LIKE)."""
    used = placed.where(F.col("project_id") == project_id).select("template_id", F.col("strand").alias("used")).distinct()
    free = reads.where("status = 'PASS'").join(placed.select("read_id"), "read_id", "left_anti")
    found = free.join(used.select("template_id"), "template_id", "left_semi")
    if not both:
        found = found.join(used.withColumnRenamed("used", "strand"), ["template_id", "strand"], "left_anti")
    return found if unlike is None else found.where(~F.col("readname").like(unlike))


def votes(reads: DataFrame, placed: DataFrame) -> DataFrame:
    """read_id, project_id, votes, strict: the project of most placed reads of the template, of the same strand if there are any.

    The lowest project wins a tie.
    """
    at = reads.select("read_id", "template_id", "strand").join(placed.select("template_id", F.col("strand").alias("s"), "project_id"), "template_id")
    n = at.groupBy("read_id", "project_id").agg(F.count_if(F.col("s") == F.col("strand")).alias("same"), F.count("*").alias("all"))
    best = n.groupBy("read_id").agg(F.max(F.struct((F.col("same") > 0).alias("strict"), F.when(F.col("same") > 0, F.col("same")).otherwise(F.col("all")).alias("votes"), (-F.col("project_id")).alias("p"))).alias("b"))
    return best.select("read_id", (-F.col("b.p")).alias("project_id"), "b.votes", "b.strict")


def hanging(used: DataFrame, projects: DataFrame) -> DataFrame:
    """Project ids in use that no project has."""
    return used.select("project_id").na.drop().distinct().join(projects.select("project_id"), "project_id", "left_anti")


def missing(names: DataFrame, reads: DataFrame) -> DataFrame:
    """Names of a list that no read has, each once."""
    return names.select("readname").na.drop().distinct().join(reads.select("readname"), "readname", "left_anti")


def oligo_walks(placed: DataFrame, oligos: DataFrame, limit: int = 1000) -> DataFrame:
    """oligo_read, contig_p, contig_q: an oligo read whose template's forward and reverse partners lie near facing ends of two contigs.

    ``oligos``: read_id, template_id.  The forward partner points out of the right end, the reverse one out of the left end.
    """
    p = placed.where((F.col("strand") == "Forward") & (F.col("direction") == "Forward") & (F.col("cstart") > F.col("contig_length") - limit)).select("template_id", F.col("contig_id").alias("contig_p"))
    q = placed.where((F.col("strand") == "Reverse") & (F.col("direction") == "Reverse") & (F.col("cfinish") < limit)).select("template_id", F.col("contig_id").alias("contig_q"))
    return oligos.select(F.col("read_id").alias("oligo_read"), "template_id").join(p, "template_id").join(q, "template_id").where("contig_p <> contig_q").select("oligo_read", "contig_p", "contig_q")


def best_overlaps(mappings: DataFrame) -> DataFrame:
    """seq_id, contig_id, other, overlap, kind: for each read the one of its contig with the largest overlap (lowest id if tied).

    kind: C it contains the read, L it starts left of it, R otherwise.  Positions are binned, so a deep contig is many small joins.
    """
    side = lambda n: mappings.select("contig_id", F.col("seq_id").alias(f"s{n}"), F.col("cstart").alias(f"a{n}"), F.col("cfinish").alias(f"b{n}"))
    met = binned(side(1), "a1", "b1").join(binned(side(2), "a2", "b2"), ["contig_id", "bin"]).where("s1 <> s2 and a2 <= b1 and b2 >= a1").where(first_bin("a1", "a2"))
    size = F.least("b1", "b2") - F.greatest("a1", "a2") + 1
    kind = F.when((F.col("a2") <= F.col("a1")) & (F.col("b2") >= F.col("b1")), "C").when(F.col("a2") < F.col("a1"), "L").otherwise("R")
    best = met.groupBy("contig_id", F.col("s1").alias("seq_id")).agg(F.max(F.struct(size.alias("overlap"), (-F.col("s2")).alias("o"), kind.alias("kind"))).alias("m"))
    return best.select("seq_id", "contig_id", (-F.col("m.o")).alias("other"), "m.overlap", "m.kind")


def nearest(tags: DataFrame, mappings: DataFrame) -> DataFrame:
    """tag_id, contig_id, seq_id: the overlapping read whose ends lie nearest to the tag's (lowest id if tied)."""
    m = mappings.select("contig_id", "seq_id", F.col("cstart").alias("a"), F.col("cfinish").alias("b"))
    met = binned(tags, "cstart", "cfinal").join(binned(m, "a", "b"), ["contig_id", "bin"]).where("a <= cfinal and b >= cstart").where(first_bin("cstart", "a"))
    far = F.abs(F.col("a") - F.col("cstart")) + F.abs(F.col("b") - F.col("cfinal"))
    best = met.groupBy("tag_id", "contig_id").agg(F.min(F.struct(far.alias("far"), "seq_id")).alias("m"))
    return best.select("tag_id", "contig_id", "m.seq_id")


def repeat_partners(placed: DataFrame, repeats: DataFrame, before: int = 0, after: int = 0) -> DataFrame:
    """contig_id, seq_id, partner, kind: reads inside a repeat (widened) and their template partners of the other strand."""
    wide = repeats.select("contig_id", (F.col("cstart") - before).alias("r0"), (F.col("cfinal") + after).alias("r1"))
    met = binned(placed, "cstart", "cstart").join(binned(wide, "r0", "r1"), ["contig_id", "bin"]).where("r0 <= cstart and r1 >= cfinish")
    inside = met.select("contig_id", "seq_id", "template_id", "strand").distinct()
    partner = placed.select("template_id", F.col("strand").alias("s"), F.col("seq_id").alias("partner"), F.col("contig_id").alias("c"))
    mine = inside.join(partner, [inside["template_id"] == partner["template_id"], F.col("s") != F.col("strand")], "left").select("contig_id", "seq_id", "partner", "c")
    there = inside.select(F.col("contig_id").alias("c"), F.col("seq_id").alias("partner"), F.lit(True).alias("inside"))
    kind = F.when(F.col("partner").isNull(), "not found").when(F.col("c") != F.col("contig_id"), "other contig").when(F.col("inside"), "in repeat").otherwise("unique")
    return mine.join(there, ["c", "partner"], "left").select("contig_id", "seq_id", "partner", kind.alias("kind"))
