"""Queries over currency, placement, sweeps along contigs and project activity; the SQL of ``placement``, ``statistics`` and ``structure`` is their oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions import activity as ac
from strandlake.functions import intervals as iv
from strandlake.functions import mappings as mp
from strandlake.functions import placements as pl
from strandlake.functions import scaffolds as sc
from strandlake.functions import selections as se
from strandlake.functions import statistics as st
from strandlake.plans.assembly import Assembly
from strandlake.plans.calls import call

AS_OF = "1997-01-01"


def small(column: str, name: str | None = None) -> Column:
    """Positions of reads are int in the SQL."""
    return F.col(column).cast("int").alias(name or column)


# ---- currency and placement

call("cur_contigs")(lambda a: pl.current(a.contig, a.c2c).select("contig_id", "project_id", "nreads", "length"))
call("cur_contigs_asof")(lambda a: pl.current_as_of(a.contig, a.c2c, AS_OF).select("contig_id", "length"))
call("initial_contigs")(lambda a: pl.initial(a.contig, a.c2c).select("contig_id"))
call("free_reads")(lambda a: pl.free_reads(a.readinfo, a.curmap).select("read_id", "readname"))
call("free_reads_by_origin")(lambda a: pl.free_by_origin(a.readinfo, a.curmap, a.template, a.ligation))
_FREE = "select read_id, readname from a_readinfo r where not exists (select 1 from a_curmap m where m.seq_id=r.read_id) and template_id {0} (select template_id from a_template where ligation_id%5=0)"
call("free_reads_ligation", _FREE.format("in"))(lambda a: pl.free_by_ligation(a.readinfo, a.curmap, a.template, a.ligation.where("ligation_id % 5 = 0")).select("read_id", "readname"))
call("free_reads_other_ligation", _FREE.format("not in"))(lambda a: pl.free_by_ligation(a.readinfo, a.curmap, a.template, a.ligation.where("ligation_id % 5 = 0"), True).select("read_id", "readname"))
call("free_reads_asof")(lambda a: pl.free_as_of(a.readinfo, a.map, a.contig, a.c2c, AS_OF).select("read_id"))
call("read_placement")(lambda a: pl.placements(a.curmap, a.readinfo, a.project))
call("read_current_contig")(lambda a: pl.current_contig(a.curmap))
call("read_with_template")(lambda a: a.readinfo.join(a.template, "template_id", "left").select("read_id", "readname", "ligation_id"))
call("dup_reads")(lambda a: pl.duplicates(a.curmap))
call("dup_reads_detail")(lambda a: pl.duplicate_placements(a.curmap).select("seq_id", "contig_id", "cstart", "cfinish"))
call("chk_duplicate_reads")(lambda a: pl.in_several_contigs(a.curmap))
call("dup_contig_pairs")(lambda a: pl.sharing_pairs(a.curmap))
call("chk_shared_reads")(lambda a: pl.sharing_pairs(a.curmap).withColumnRenamed("shared", "n"))
call("dup_read_allocation")(lambda a: pl.allocation(a.curmap))
call("shared_segments")(lambda a: pl.shared_segments(a.once("map")))
call("contig_family")(lambda a: pl.family(a.once("map")))
call("current_for_ancestor")(lambda a: pl.current_for_ancestors(a.curmap, a.map, a.c2c))
call("template_span")(lambda a: pl.template_spans(a.place))
call("clip_excess")(lambda a: pl.clip_excess(a.mapping, a.qualityclip))
call("end_reads")(lambda a: pl.end_reads(a.map, a.contig))
call("single_read_parents")(lambda a: pl.single_read_parents(a.c2c, a.contig))
call("chk_cleanup_preview")(lambda a: pl.unlisted_segments(a.segment, a.cur))
call("template_bridges")(lambda a: sc.hooks(a.place).groupBy("template_id").agg(F.count_distinct("contig_id").alias("contigs")).where("contigs > 1"))

# ---- sweeps and mappings

call("coverage_depth")(lambda a: iv.coverage(a.once("map")))
call("contig_holes")(lambda a: iv.holes(a.once("map")))
call("contig_islands")(lambda a: iv.islands(a.once("map")))
call("segment_collate")(lambda a: iv.collated(a.seg, 2).select("contig_id", "seq_id", "part", F.col("x0").alias("cstart"), (F.col("x1") - F.col("x0") + 1).alias("length")))
call("dedupe_tags")(lambda a: iv.deduped_tags(a.once("tag"), merge=True))
call("map_split")(lambda a: mp.parts(a.seg).select("contig_id", "seq_id", "part", "x0", "x1", small("y0"), small("y1")))
call("map_extents")(lambda a: mp.extents(a.seg, "contig_id").select("contig_id", F.col("xmin").alias("cmin"), F.col("xmax").alias("cmax"), small("ymin", "rmin"), small("ymax", "rmax")))
call("mapping_extent")(lambda a: mp.extents(a.seg, "contig_id", "seq_id").select("contig_id", "seq_id", small("ymin", "rmin"), small("ymax", "rmax")))
call("map_compare")(lambda a: mp.compared(a.once("seg"), a.once("seg"), a.c2c).withColumns({c: small(c) for c in ("y_first", "y_last")}))
call("map_transform_string")(lambda a: carried(a))


def carried(a: Assembly) -> DataFrame:
    """Mappings with their segments as they are made, each joined to the letters of its read last, by document."""
    return a.joined(a.arrayed.withColumn("parts", F.sort_array("parts")), mp.complemented(a.first_letters())).select("contig_id", "seq_id", mp.along("parts").alias("carried"))



# ---- counts and activity

call("contig_stats_month")(lambda a: ac.contigs_by_month(a.cur))
call("reads_by_month")(lambda a: ac.reads_by_month(a.readinfo))
call("template_strand_counts")(lambda a: ac.strand_counts(a.readinfo))
call("total_length")(lambda a: st.totals(a.cur, "project_id").select("project_id", "total_length"))
call("directories")(lambda a: se.project_inventory(a.project, a.contig).select(F.col("name").alias("directory")).distinct())
call("top_contigs")(lambda a: ac.top(a.cur, 100, longer=1000).select("contig_id", "length"))
call("last_added_contig")(lambda a: ac.last_added(a.contig))
call("import_export_latest")(lambda a: ac.latest(a.importexport))
call("latest_note")(lambda a: ac.latest_note(a.importexport))
call("transfer_counts")(lambda a: ac.transfer_counts(a.transfer))
call("last_transfer_out")(lambda a: ac.last_transfer_out(a.transfer))
call("last_change")(lambda a: ac.last_change(a.cur, a.importexport, a.transfer))
call("export_pending")(lambda a: ac.export_pending(a.cur, a.importexport))


@call("not_reassigned")
def not_reassigned(a: Assembly) -> DataFrame:
    """The requests as they are, with three projects locked, and once more with ids of three projects on, some of which are missing."""
    on = a.transfer.withColumn("new_project_id", F.col("new_project_id") + 3)
    return ac.not_reassigned(a.transfer, a.contig, a.project, [0, 1, 2]).unionByName(ac.not_reassigned(on, a.contig, a.project, []))
