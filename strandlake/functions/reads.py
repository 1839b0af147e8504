"""Checks and imports of reads, and the surfaces that users extend."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: What makes a read incomplete, in order.
RULES = {
    "no date": "asped is null", "no chemistry": "chemistry is null", "no ligation": "ligation_id is null", "no clip": "qleft is null", "no sequence": "dna is null",
    "lengths differ": "length(dna) <> size(quality)", "no pass": "status <> 'PASS'",
}


def incomplete(reads: DataFrame, skip: tuple[str, ...] = ()) -> DataFrame:
    """read_id, failed: all rules that a read fails, in order, comma-separated; rules in ``skip`` aren't tested."""
    tests = [F.when(F.expr(test), F.lit(name)) for name, test in RULES.items() if name not in skip]
    return reads.select("read_id", F.concat_ws(", ", *tests).alias("failed")).where("failed <> ''")


def unplaced(reads: DataFrame, placed: DataFrame, screened: DataFrame) -> DataFrame:
    """Reads (read_id, ...) without a mapping, with their screened clip."""
    return reads.join(placed.select(F.col("seq_id").alias("read_id")), "read_id", "left_anti").join(screened.withColumnRenamed("seq_id", "read_id"), "read_id", "left")


def with_status(free: DataFrame, least: int = 1) -> DataFrame:
    """Unplaced reads (read_id, dna, qleft, qright, ...) with length of their good range and status, see ``single_read_contigs``."""
    size = F.col("qright") - F.col("qleft") - 1
    status = F.when(F.col("dna").isNull(), "no sequence").when(F.col("qleft").isNull() | F.col("qright").isNull(), "no clip").when(size < least, "too short").otherwise("ok")
    return free.withColumn("length", size).withColumn("status", status)


def single_read_contigs(reads: DataFrame, placed: DataFrame, screened: DataFrame, least: int = 1) -> dict[str, DataFrame]:
    """Tables for unplaced reads as contigs of their own: status, contig, mapping, segment, consensus.

    ``reads``: read_id, dna, quality; ``screened``: seq_id, qleft, qright after vector screening.  The contig is the range qleft + 1 ..
    qright - 1; its id is the read's.  status: ok, no sequence, no clip or too short.
    """
    at = with_status(unplaced(reads, placed, screened), least)
    good = at.where("status = 'ok'")
    first = (F.col("qleft") + 1).cast("int")
    return {
        "status": at.select("read_id", "status"),
        "contig": good.select(F.col("read_id").alias("contig_id"), F.lit(1).alias("nreads"), "length"),
        "mapping": good.select(F.col("read_id").alias("contig_id"), F.col("read_id").alias("seq_id"), F.lit(1).alias("cstart"), F.col("length").alias("cfinish"), F.lit("Forward").alias("direction")),
        "segment": good.select(F.col("read_id").alias("contig_id"), F.col("read_id").alias("seq_id"), F.lit(1).alias("cstart"), first.alias("rstart"), "length"),
        "consensus": good.select(F.col("read_id").alias("contig_id"), F.substring("dna", first, F.col("length").cast("int")).alias("dna"), F.slice("quality", first, F.col("length").cast("int")).alias("quality")),
    }


def low_quality_reads(segments: DataFrame, low: DataFrame, bin_size: int = 1000) -> DataFrame:
    """contig_id, seq_id, pads, pairs: how many low positions (contig_id, pos) of its contig a read covers, and with how many reads in all.

    ``pairs`` counts, over these positions, the other reads there.
    """
    from strandlake.functions.mappings import binned

    at = low.withColumn("bin", F.floor(F.col("pos") / bin_size))
    met = binned(segments, "x0", "x1", bin_size).join(at, ["contig_id", "bin"]).where("pos >= x0 and pos <= x1").select("contig_id", "seq_id", "pos").distinct()
    depth = met.groupBy("contig_id", "pos").agg((F.count("*") - 1).alias("others"))
    return met.join(depth, ["contig_id", "pos"]).groupBy("contig_id", "seq_id").agg(F.count("*").alias("pads"), F.sum("others").alias("pairs"))


def placed_matches(matches: DataFrame, clips: DataFrame, lengths: DataFrame, most: float = 5.0, fuzz: int = 20, multiple: bool = False) -> DataFrame:
    """one, two, kind for matches of at most ``most`` per cent substitutions, deletions and insertions.

    kind: W the whole contig, L or R its left or right end, C inside, P only a part of the read's good range is matched.  Reads that
    cover a whole contig go; the rest is unique placements, or with ``multiple`` the reads of several contigs.
    """
    good = matches.where((F.col("subs") <= most) & (F.col("dels") <= most) & (F.col("inss") <= most))
    at = good.join(clips.select(F.col("readname").alias("one"), "qleft", "qright"), "one", "left").join(lengths.select(F.col("contig").alias("two"), "length"), "two")
    low, high = F.least("two_first", "two_last"), F.greatest("two_first", "two_last")
    left, right = low <= fuzz, high > F.col("length") - fuzz
    part = (F.col("one_first") > F.coalesce("qleft", F.lit(0)) + fuzz) & ~left | (F.col("one_last") < F.coalesce("qright", "one_last") - fuzz) & ~right
    kind = F.when(left & right, "W").when(part, "P").when(left, "L").when(right, "R").otherwise("C")
    at = at.withColumn("kind", kind).where("kind <> 'W'")
    many = at.groupBy("one").agg(F.count_distinct("two").alias("contigs"))
    return at.join(many, "one").where("contigs > 1" if multiple else "contigs = 1").select("one", "two", "kind")


def facts(fasta: DataFrame) -> DataFrame:
    """name, length, seq_hash of FASTA rows (name, dna)."""
    return fasta.select("name", F.length("dna").alias("length"), F.md5("dna").alias("seq_hash"))


def met(known: DataFrame, told: DataFrame, key: str) -> DataFrame:
    """Rows of ``known`` that ``told`` names: few, if few are told, and then no others are shuffled."""
    return known.join(told.select(key), key, "left_semi")


def fresh_consensus(told: DataFrame, known: DataFrame) -> DataFrame:
    """readname, template (the name up to its first dot), length, seq_hash of ``facts`` whose names are not ``known`` (readname); of a name that
    stands more than once the sequence of the least digest."""
    fresh = told.join(met(known.select(F.col("readname").alias("name")), told, "name"), "name", "left_anti").groupBy("name").agg(F.min(F.struct("seq_hash", "length")).alias("m"))
    return fresh.select(F.col("name").alias("readname"), F.regexp_extract("name", r"^([^.]+)", 1).alias("template"), "m.length", "m.seq_hash")


def new_templates(fresh: DataFrame, templates: DataFrame) -> DataFrame:
    """template of ``fresh_consensus`` that is none of ``templates`` (name)."""
    named = fresh.select("template").distinct()
    return named.join(met(templates.select(F.col("name").alias("template")), named, "template"), "template", "left_anti")


def imported_consensus(fasta: DataFrame, known: DataFrame, templates: DataFrame, quality: int = 15) -> dict[str, DataFrame]:
    """Tables reads, template, sequence, clip and tag of FASTA rows (name, dna) whose names are not ``known`` (readname), see ``fresh_consensus``.

    Ids of new templates follow the highest stored one, in order of name, within hash buckets: bucket counts are summed first, so no
    task numbers all rows.  Lengths and digests are told before any join; letters travel for the table of sequences only.
    """
    at = fresh_consensus(facts(fasta), known)
    new = new_templates(at, templates).withColumn("b", F.pmod(F.xxhash64("template"), F.lit(4096)))
    counts = new.groupBy("b").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(W.orderBy("b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    top = templates.agg(F.coalesce(F.max("template_id"), F.lit(0)).alias("top"))
    ids = new.join(counts, "b").join(F.broadcast(top)).select("template", (F.col("top") + F.col("before") + F.row_number().over(W.partitionBy("b").orderBy("template"))).alias("template_id"))
    told = fasta.join(known.select(F.col("readname").alias("name")), "name", "left_anti").groupBy("name").agg(F.min_by("dna", F.md5("dna")).alias("dna"))
    return {
        "reads": at,
        "template": ids,
        "sequence": told.select(F.col("name").alias("readname"), "dna", F.array_repeat(F.lit(quality), F.length("dna")).alias("quality")),
        "clip": at.select("readname", F.lit(0).alias("qleft"), (F.col("length") + 1).alias("qright")),
        "tag": at.select("readname", F.lit("CONS").alias("tagtype"), F.lit(1).alias("first"), F.col("length").alias("last")),
    }


def processed(rows: DataFrame, work: Callable[[pd.DataFrame], pd.DataFrame], schema: str, key: str = "contig_id", together: bool = False) -> DataFrame:
    """A user's function of all rows of a contig, for every contig of a selection; with ``together`` it gets the rows of many contigs, each whole, so that
    short contigs don't cost a call each."""
    if not together:
        return rows.groupBy(key).applyInPandas(work, schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            keys = batch[key].to_numpy()
            if len(keys) == 0:
                continue
            last = int(np.searchsorted(keys, keys[-1]))  # where the contig begins that the next batch may go on with
            if last or (held and held[-1][key].iloc[-1] != keys[-1]):
                yield work(pd.concat([*held, batch.iloc[:last]], ignore_index=True))
                held = []
            held.append(batch.iloc[last:])
        if held:
            yield work(pd.concat(held, ignore_index=True))

    return rows.where(F.col(key).isNotNull()).repartition(key).sortWithinPartitions(key).mapInPandas(run, schema)


def versions_matched(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """readname, version, is_new of every incoming sequence: the stored version (readname, version, seq_hash, qual_hash) equal to it, else the next one.

    A read's versions are few, so those of a name are held together and each side is shuffled once.
    """
    of_read = stored.groupBy("readname").agg(F.collect_list(F.struct("version", "seq_hash", "qual_hash")).alias("versions"))
    same = F.filter("versions", lambda v: (v["seq_hash"] == F.col("seq_hash")) & (v["qual_hash"] == F.col("qual_hash")))
    at = incoming.join(of_read, "readname", "left").select("readname", F.array_min(same["version"]).alias("held"), F.array_max("versions.version").alias("last"))
    return at.select("readname", F.coalesce("held", F.col("last") + 1, F.lit(0)).alias("version"), F.col("held").isNull().alias("is_new"))
