"""Rules of integrity as data: (id, critical, builder of the offending rows, message)."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lacking(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows of ``child`` whose key is not null and has no row in ``parent``."""
    known = parent.select(F.col(parent_key).alias(key))  # an anti join minds no duplicates, so no table of keys is held for them
    return child.where(F.col(key).isNotNull()).join(known, key, "left_anti")


def mapping_counts(contigs: DataFrame, mappings: DataFrame, since=None) -> DataFrame:
    """contig_id, nreads, mappings where both differ; ``since``: only contigs updated from that day on."""
    if since is not None:
        contigs = contigs.where(F.col("updated") >= F.lit(since).cast("date"))
    n = mappings.groupBy("contig_id").agg(F.count_distinct("seq_id").alias("mappings"))
    return contigs.select("contig_id", "nreads").join(n, "contig_id", "left").na.fill(0, ["mappings"]).where("nreads <> mappings")


def without_sequence(reads: DataFrame, versions: DataFrame, sequences: DataFrame) -> DataFrame:
    """read_id, problem: no sequence, empty sequence or no quality (in the original version)."""
    own = versions.where("version = 0").select("read_id", "seq_id")
    # the flaws are told before the join, so that no letters travel
    flaw = F.when(F.col("dna").isNull(), "no sequence").when(F.col("dna") == "", "empty sequence").when(F.col("quality").isNull(), "no quality").otherwise("")
    at = reads.select("read_id").join(own, "read_id", "left").join(sequences.select("seq_id", flaw.alias("flaw")), "seq_id", "left")
    problem = F.when(F.col("flaw").isNull(), "no sequence").when(F.col("flaw") != "", F.col("flaw"))
    return at.select("read_id", problem.alias("problem")).where("problem is not null")


def foreign_keys(tables: dict[str, DataFrame], constraints: list[tuple[str, str, str, str]]) -> DataFrame:
    """fk, missing: for each (child table, key, parent table, key), how many child rows lack their parent."""
    found = None
    for child, key, parent, parent_key in constraints:
        one = lacking(tables[child], key, tables[parent], parent_key).agg(F.count("*").alias("missing")).select(F.lit(f"{child}.{key}").alias("fk"), "missing")
        found = one if found is None else found.unionByName(one)
    return found


class Rule(NamedTuple):
    critical: bool
    rows: Callable[[dict[str, DataFrame]], DataFrame]
    message: str
    keys: tuple[str, ...]


#: Rules over tables contig, mapping, reads, clip, versions, sequences, template, ligation, clone.
RULES: dict[str, Rule] = {
    "mapping_count": Rule(True, lambda t: mapping_counts(t["contig"], t["mapping"]), "contig %s has %s reads but %s mappings", ("contig_id", "nreads", "mappings")),
    "orphan_contigs": Rule(True, lambda t: t["contig"].where("nreads = 0"), "contig %s has no reads", ("contig_id",)),
    "mapping_contig": Rule(True, lambda t: lacking(t["mapping"], "contig_id", t["contig"], "contig_id"), "sequence %s is mapped to contig %s, which does not exist", ("seq_id", "contig_id")),
    "mapping_read": Rule(True, lambda t: lacking(t["mapping"], "seq_id", t["versions"], "seq_id"), "sequence %s in contig %s has no read", ("seq_id", "contig_id")),
    "clip": Rule(False, lambda t: lacking(t["versions"], "seq_id", t["clip"], "seq_id"), "sequence %s has no quality clip", ("seq_id",)),
    "seq2read": Rule(True, lambda t: lacking(t["sequences"], "seq_id", t["versions"], "seq_id"), "sequence %s belongs to no read", ("seq_id",)),
    "seq_read": Rule(True, lambda t: lacking(t["versions"], "read_id", t["reads"], "read_id"), "sequence %s belongs to read %s, which does not exist", ("seq_id", "read_id")),
    "template": Rule(False, lambda t: lacking(t["reads"], "template_id", t["template"], "template_id"), "read %s has no template %s", ("read_id", "template_id")),
    "ligation": Rule(False, lambda t: lacking(t["template"], "ligation_id", t["ligation"], "ligation_id"), "template %s has no ligation %s", ("template_id", "ligation_id")),
    "clone": Rule(False, lambda t: lacking(t["ligation"], "clone_id", t["clone"], "clone_id"), "ligation %s has no clone %s", ("ligation_id", "clone_id")),
}


def check(tables: dict[str, DataFrame], *ids: str) -> DataFrame:
    """rule, critical, message of every offence against the given rules, all of them by default."""
    found = None
    for name in ids or RULES:
        rule = RULES[name]
        text = F.format_string(rule.message, *(F.col(k).cast("string") for k in rule.keys))
        one = rule.rows(tables).select(F.lit(name).alias("rule"), F.lit(rule.critical).alias("critical"), text.alias("message"))
        found = one if found is None else found.unionByName(one)
    return found
