"""Readers of assembly text formats: every file is split into records by Spark's text source, fields by expressions.

All readers take a path or a list of paths and stay lazy; a large file is read by several tasks, as records end at a
fixed separator.  Records without the wanted fields give no rows; an empty file gives none.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def records(spark: SparkSession, path: str | list[str], separator: str) -> DataFrame:
    return spark.read.option("lineSep", separator).text(path).where(F.trim("value") != "")


def fasta_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """name, body: the first word of each head line and the lines below."""
    rows = records(spark, path, "\n>")
    return rows.select(
        F.regexp_extract("value", r"^>?\s*(\S+)", 1).alias("name"), F.regexp_replace("value", r"^[^\n]*\n?", "").alias("body")
    ).where("name <> ''")


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """name, dna; lines with other letters than A, C, G, T, N and X, in either case, are left out."""
    lines = F.filter(F.split("body", r"\r?\n"), lambda line: line.rlike(r"^[ACGTNXacgtnx]+$"))
    return fasta_records(spark, path).select("name", F.array_join(lines, "").alias("dna"))


def read_fasta_pair(spark: SparkSession, path: str | list[str], quality_path: str | list[str]) -> DataFrame:
    """name, dna, quality (null for a sequence without qualities); qualities of unknown names go."""
    return read_fasta(spark, path).join(read_fasta_quality(spark, quality_path), "name", "left")


def read_fasta_quality(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """name, quality (array of int)."""
    words = F.filter(F.split("body", r"\s+"), lambda w: w != "")
    return fasta_records(spark, path).select("name", words.cast("array<int>").alias("quality"))


def caf_blocks(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """kind (Sequence, DNA, BaseQuality), name, body of the blank-line separated blocks; continued lines are joined."""
    text = F.when(F.contains("value", F.lit("\\n\\\n")), F.regexp_replace("value", r"\\n\\\n", " ")).otherwise(F.col("value"))
    rows = records(spark, path, "\n\n").select(F.ltrim(text, F.lit(" \t\n\x0b\f\r")).alias("value"))
    rows = rows.select("value", F.substring_index("value", "\n", 1).alias("first"))  # patterns see short strings only
    head = r"^(Sequence|DNA|BaseQuality)\s*:\s*(\S+)"
    at = rows.where(F.col("first").rlike(head)).select(F.regexp_extract("first", head, 1).alias("kind"), F.regexp_extract("first", head, 2).alias("name"), "value", "first")
    return at.select("kind", "name", F.substring("value", F.length("first") + 2, F.lit(2**31 - 1)).alias("body"))


def _lines(rows: DataFrame, pattern: str, names: dict[str, str], keep: str) -> DataFrame:
    """A row per line of ``body`` that matches; ``names`` gives the groups of the pattern in order, with their types."""
    each = rows.select(F.col("name").alias(keep), F.explode(F.regexp_extract_all("body", F.lit(pattern), F.lit(0))).alias("line"))
    return each.select(keep, *(F.regexp_extract("line", pattern, k).cast(t).alias(n) for k, (n, t) in enumerate(names.items(), 1)))


def caf_segments(blocks: DataFrame) -> DataFrame:
    """contig, read, cstart, cfinish, rstart, rfinish of every Assembled_from line."""
    names = {"read": "string"} | dict.fromkeys(("cstart", "cfinish", "rstart", "rfinish"), "long")
    return _lines(blocks.where("kind = 'Sequence'"), r"(?m)^Assembled_from\s+(\S+)\s+(\d+)\s+(\d+)\s+(\d+)\s+(\d+)", names, "contig")


def caf_tags(blocks: DataFrame) -> DataFrame:
    """name, tagtype, first, last, comment of every Tag line."""
    names = {"tagtype": "string", "first": "long", "last": "long", "comment": "string"}
    return _lines(blocks.where("kind = 'Sequence'"), r'(?m)^Tag\s+(\S+)\s+(\d+)\s+(\d+)(?:\s+"([^"\n]*)")?', names, "name")


def caf_clips(blocks: DataFrame) -> DataFrame:
    """name, kind, first, last of every Clipping line."""
    names = {"clip": "string", "first": "long", "last": "long"}
    return _lines(blocks.where("kind = 'Sequence'"), r"(?m)^Clipping\s+(\S+)\s+(\d+)\s+(\d+)", names, "name")


def caf_vectors(blocks: DataFrame) -> DataFrame:
    """name, kind (Seq_vec or Clone_vec), vector, first, last of every vector line."""
    names = {"kind": "string", "method": "string", "first": "long", "last": "long", "vector": "string"}
    return _lines(blocks.where("kind = 'Sequence'"), r'(?m)^(Seq_vec|Clone_vec)\s+(\S+)\s+(\d+)\s+(\d+)(?:\s+"([^"\n]*)")?', names, "name").drop("method")


def caf_reads(blocks: DataFrame) -> DataFrame:
    """name, template, strand, si_low, si_high, asped of the reads; null where a line is missing."""
    one = lambda pattern, k=1: F.nullif(F.regexp_extract("body", rf"(?m)^{pattern}", k), F.lit(""))
    at = blocks.where((F.col("kind") == "Sequence") & F.col("body").rlike(r"(?m)^Is_read"))
    return at.select("name", one(r"Template\s+(\S+)").alias("template"), one(r"Strand\s+(\S+)").alias("strand"), one(r"Insert_size\s+(\d+)\s+(\d+)").cast("long").alias("si_low"),
                     one(r"Insert_size\s+(\d+)\s+(\d+)", 2).cast("long").alias("si_high"), F.try_to_date(one(r"Asped\s+(\S+)")).alias("asped"))


def caf_sequences(blocks: DataFrame) -> DataFrame:
    """name, dna, quality (null where there is no BaseQuality block), one row per name in each block kind."""
    dna = blocks.where("kind = 'DNA'").select("name", F.regexp_replace("body", r"\s+", "").alias("dna"))
    words = F.filter(F.split("body", r"\s+"), lambda w: w != "").cast("array<int>")
    return dna.join(blocks.where("kind = 'BaseQuality'").select("name", words.alias("quality")), "name", "left")


def caf_digests(blocks: DataFrame) -> DataFrame:
    """name, n (letters), digest (md5 of them), more (number of qualities, null where there is no BaseQuality block), of one DNA block a name.

    Digests and numbers are made where a block is read, so that no letters are shuffled; a digest travels as two numbers, as these are aggregated without sorting.
    """
    names = ["name", "n", "h1", "h2", "more"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for kind, name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist()):
                if kind == "DNA":
                    dna = body.translate(None, b" \t\n\x0b\f\r")
                    out.append((name, len(dna) if dna.isascii() else len(dna.decode()), *struct.unpack(">qq", hashlib.md5(dna).digest()), None))
                else:
                    out.append((name, None, None, None, len(body.split())))
            columns = zip(*out) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k == 0 else pa.int64()) for k, c in enumerate(columns)], names=names)

    rows = blocks.where("kind in ('DNA', 'BaseQuality')").select("kind", "name", "body").mapInArrow(run, "name string, n long, h1 long, h2 long, more long")
    sums = rows.groupBy("name").agg(F.max("n").alias("n"), F.max("h1").alias("h1"), F.max("h2").alias("h2"), F.max("more").alias("more")).where("n is not null")
    back = [F.lower(F.lpad(F.hex(h), 16, "0")) for h in ("h1", "h2")]
    return sums.select("name", "n", F.concat(*back).alias("digest"), "more")


def caf_heads(blocks: DataFrame) -> DataFrame:
    """name, kind, n, digest, more of Sequence blocks, in one pass: contig with the number of its Assembled_from lines and the sum of their first places, read with its
    upper insert size, template and strand, and the end of its clipping."""
    one = lambda pattern, k=1: F.nullif(F.regexp_extract("body", rf"(?m)^{pattern}", k), F.lit(""))
    every = lambda pattern, k: F.regexp_extract_all("body", F.lit(pattern), F.lit(k)).cast("array<long>")
    row = lambda kind, n, digest, more: F.struct(F.lit(kind).alias("kind"), n.cast("long").alias("n"), digest.cast("string").alias("digest"), more.cast("long").alias("more"))
    starts = every(r"(?m)^Assembled_from\s+\S+\s+(\d+)\s+\d+\s+\d+\s+\d+", 1)
    contig = F.array(row("contig", F.size(starts), F.lit(None), F.aggregate(starts, F.lit(0).cast("long"), lambda a, x: a + x)))
    ends = every(r"(?m)^Clipping\s+\S+\s+\d+\s+(\d+)", 1)
    read = F.transform(F.when(F.size(ends) > 0, ends).otherwise(F.array(F.lit(None).cast("long"))),
                       lambda e: row("read", one(r"Insert_size\s+(\d+)\s+(\d+)", 2), F.concat_ws(" ", one(r"Template\s+(\S+)"), one(r"Strand\s+(\S+)")), e))
    found = F.when(F.col("body").rlike(r"(?m)^Is_read"), read).when(F.size(starts) > 0, contig)
    return blocks.where("kind = 'Sequence'").select("name", F.inline(found))


def read_embl(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """contig, tagtype, first, last, strand: the features of every entry."""
    rows = records(spark, path, "\n//\n").select(F.regexp_extract("value", r"(?m)^ID\s+([^\s;]+)", 1).alias("name"), F.col("value").alias("body"))
    names = {"tagtype": "string", "turned": "string", "first": "long", "last": "long"}
    found = _lines(rows.where("name <> ''"), r"(?m)^FT   (\S+)\s+(complement\()?(\d+)\.\.(\d+)", names, "contig")
    return found.select("contig", "tagtype", "first", "last", F.when(F.col("turned") == "", "F").otherwise("R").alias("strand"))


def read_experiment(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per experiment record: name, template, asped, ligation, si_low, si_high, strand_code, chemistry, basecaller,
    qleft, qright, status, tags (array), comments (array), trace, clone, direction, quality (array of int), dna.  Records end with a line ``//``."""
    rows = records(spark, path, "\n//\n")
    one = lambda code: F.nullif(F.regexp_extract("value", rf"(?m)^{code}\s+([^\n]+)", 1), F.lit(""))
    size = lambda k: F.nullif(F.regexp_extract("value", r"(?m)^SI\s+(\d+)\.\.(\d+)", k), F.lit("")).cast("int")
    return rows.select(
        one("ID").alias("name"), one("TN").alias("template"), F.to_date(one("DT")).alias("asped"), one("LG").alias("ligation"),
        size(1).alias("si_low"), size(2).alias("si_high"), one("PR").alias("strand_code"), one("CH").alias("chemistry"),
        one("BC").alias("basecaller"), one("QL").cast("int").alias("qleft"), one("QR").cast("int").alias("qright"),
        one("PS").alias("status"), one("LN").alias("trace"), one("CN").alias("clone"), one("DR").alias("direction"),
        F.regexp_extract_all("value", F.lit(r"(?m)^CC\s+([^\n]+)"), F.lit(1)).alias("comments"),
        F.filter(F.split(F.array_join(F.regexp_extract_all("value", F.lit(r"(?m)^AV\s+([^\n]+)"), F.lit(1)), " "), r"\s+"), lambda w: w != "").cast("array<int>").alias("quality"), F.regexp_extract_all("value", F.lit(r"(?m)^TG\s+([^\n]+)"), F.lit(1)).alias("tags"),
        F.regexp_replace(F.regexp_extract("value", r"(?s)\nSQ[^\n]*\n(.*?)(?:\n//|$)", 1), r"\s+", "").alias("dna"),
    ).where("name is not null")


def read_crossmatch(spark: SparkSession, path: str | list[str], least: int = 0) -> DataFrame:
    """score, subs, dels, inss, one, one_first, one_last, one_tail, turned, two, two_first, two_last, two_tail.

    A ``C`` (or ``c``) in the ninth word shifts the rest by one and puts the tail of the second sequence first.  Its two ends stay in the
    order of the line, so the first of a complement match is usually the larger.
    """
    rows = spark.read.text(path).where(F.col("value").rlike(r"^\s*\d+\s+[\d.]+\s+[\d.]+\s+[\d.]+\s+\S+\s+\d+\s+\d+\s+\(\d+\)"))
    w = F.split(F.trim("value"), r"\s+")
    turned = F.upper(F.get(w, F.lit(8))) == "C"
    at = lambda k: F.regexp_replace(F.get(w, k), r"[()]", "")
    pick = lambda plain, other: F.when(turned, at(F.lit(other))).otherwise(at(F.lit(plain)))
    number = lambda k, kind="long": at(F.lit(k)).cast(kind)
    return rows.select(
        number(0).alias("score"), *(number(k, "double").alias(n) for k, n in ((1, "subs"), (2, "dels"), (3, "inss"))),
        at(F.lit(4)).alias("one"), number(5).alias("one_first"), number(6).alias("one_last"), number(7).alias("one_tail"),
        turned.alias("turned"), pick(8, 9).alias("two"), pick(9, 11).cast("long").alias("two_first"),
        pick(10, 12).cast("long").alias("two_last"), pick(11, 10).cast("long").alias("two_tail"),
    ).where(F.col("score") >= least)


def read_list(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """name, value (null if alone) of tab-separated lines; blank lines and those that begin with # are left out."""
    line = F.trim("value")
    rows = spark.read.text(path).where((line != "") & ~line.startswith("#"))
    return rows.select(F.get(F.split(line, "\t"), F.lit(0)).alias("name"), F.get(F.split(line, "\t"), F.lit(1)).alias("value"))


def read_jdbc_reads(spark: SparkSession, url: str, source: str, known: DataFrame, parts: int = 16, key: str = "read_id", **options: str) -> DataFrame:
    """Rows of a relational table of reads (with readname and a numeric read_id) whose names are not in ``known`` yet.

    The scan is split by ranges of read_id, whose bounds the store gives; ``key`` is how the store's SQL writes that column.
    """
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    low, high = reader.option("query", f"select min({key}) as a, max({key}) as b from {source}").load().first()
    reader = spark.read.format("jdbc").option("url", url).options(**options).option("dbtable", source)
    if low is not None:
        reader = reader.options(partitionColumn="read_id", lowerBound=str(low), upperBound=str(high + 1), numPartitions=str(parts))
    return reader.load().join(known.select("readname"), "readname", "left_anti")
