"""Scaffolds: chains of contigs over bridges, and chains of scaffolds over long inserts.

Placements: contig_id, contig_length, seq_id, template_id, strand, direction, cstart, cfinish, sihigh.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.functions import rounds
from strandlake.operators.components import components, kept


def hooks(placed: DataFrame, limit: int = 8000, inserts: int = 8000) -> DataFrame:
    """Placements near an end that point outwards, with ``side`` and ``overhang`` (at least 1); inserts up to ``inserts``."""
    right = (F.col("direction") == "Forward") & (F.col("cstart") > F.col("contig_length") - limit)
    left = (F.col("direction") == "Reverse") & (F.col("cfinish") < limit)
    at = placed.where(F.col("sihigh") <= inserts).withColumn("side", F.when(right, "R").when(left, "L")).where("side is not null")
    beyond = F.when(F.col("side") == "R", F.col("cstart") + F.col("sihigh") - F.col("contig_length")).otherwise(F.col("sihigh") - F.col("cfinish"))
    return at.withColumn("overhang", beyond).where("overhang >= 1")


def links(placed: DataFrame, limit: int = 8000, inserts: int = 8000) -> DataFrame:
    """one, side, other, other_side, template_id, gap: a row per hook and mate of the opposite strand in another contig, gap over 0."""
    mate = placed.select("template_id", F.col("strand").alias("s"), F.col("contig_id").alias("other"), F.col("direction").alias("d"),
                         F.col("contig_length").alias("n"), F.col("cstart").alias("a"), F.col("cfinish").alias("b"))
    met = hooks(placed, limit, inserts).join(mate, "template_id").where("s <> strand and other <> contig_id")
    forward = F.col("d") == "Forward"
    gap = F.col("overhang") - F.when(forward, F.col("n") - F.col("a")).otherwise(F.col("b"))
    return met.select(F.col("contig_id").alias("one"), "side", "other", F.when(forward, "R").otherwise("L").alias("other_side"), "template_id", gap.alias("gap")).where("gap > 0")


def ends(linked: DataFrame) -> DataFrame:
    """one, side, other, other_side, n (links), gap (least)."""
    return linked.groupBy("one", "side", "other", "other_side").agg(F.count("*").alias("n"), F.min("gap").alias("gap"))


CHAIN = "scaffold long, ordinal long, item long, direction string, gap_before long"


def grown(seeds: list, out_of: dict) -> list[tuple]:
    """Rows of ``CHAIN`` of one component: ``seeds`` in order, ``out_of`` (item, side) the ends it may go on to, best first."""
    known, used, rows = set(seeds), set(), []
    for seed in seeds:
        if seed in used:
            continue
        used.add(seed)
        parts = {"R": [], "L": []}
        for way in ("R", "L"):
            at, end = seed, way
            while found := next((o for o in out_of.get((at, end), ()) if o[0] not in used and o[0] in known), None):
                other, side, gap = found
                used.add(other)
                parts[way].append((other, "F" if side != way else "R", gap))
                at, end = other, "R" if side == "L" else "L"
        line = parts["L"][::-1]
        gaps = [None, *(g for _, _, g in line), *(g for _, _, g in parts["R"])]
        whole = [*((i, d) for i, d, _ in line), (seed, "F"), *((i, d) for i, d, _ in parts["R"])]
        rows += [(seed, k, i, d, g) for k, ((i, d), g) in enumerate(zip(whole, gaps, strict=True), 1)]
    return rows


def chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``grown`` for each component of a partition sorted by root, items before bridges; one component is held at a time."""
    types = pa.schema([("scaffold", pa.int64()), ("ordinal", pa.int64()), ("item", pa.int64()), ("direction", pa.string()), ("gap_before", pa.int64())])
    made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 5, types, strict=True)], schema=types)
    root, seeds, out_of = None, [], defaultdict(list)
    for batch in batches:
        rows = []
        for at, item, side, other, other_side, gap in zip(*(batch.column(c).to_pylist() for c in ("root", "item", "side", "other", "other_side", "gap")), strict=True):
            if at != root:
                rows += grown(seeds, out_of)
                root, seeds, out_of = at, [], defaultdict(list)
            if other is None:
                seeds.append(item)
            else:
                out_of[item, side].append((other, other_side, gap))
        yield made(rows)
    yield made(grown(seeds, out_of))


def chained(items: DataFrame, bridges: DataFrame, least: int = 2, most: int = 100_000) -> DataFrame:
    """``CHAIN``: greedy chains of items (item, rank; the lowest rank seeds first) over bridges (one, side, other, other_side, n, gap).

    A chain grows from its seed to the right, then to the left, each time to the unused item end of the most links (lowest item, then L, if
    tied), as long as there are ``least``.  Chains can't leave a connected component, so components of up to ``most`` items and bridges are chained
    side by side, many in a task and one after the other; larger ones by ``rounds.grown``, which holds none in a task and makes the same chains.
    """
    known = items.select(F.col("item").alias("one"))
    strong = kept(bridges.where(F.col("n") >= least).join(known, "one", "left_semi").join(known.withColumnRenamed("one", "other"), "other", "left_semi").select(
        "one", "side", "other", "other_side", F.col("n").cast("long").alias("n"), F.col("gap").cast("long").alias("gap")))
    roots = components(strong.select(F.col("one").alias("a"), F.col("other").alias("b")))
    at = items.select("item", F.col("rank").cast("long").alias("rank")).join(roots.withColumnRenamed("node", "item"), "item", "left")
    alone = at.where("root is null").select(
        F.col("item").alias("scaffold"), F.lit(1).cast("long").alias("ordinal"), "item", F.lit("F").alias("direction"), F.lit(None).cast("long").alias("gap_before"))
    edges = strong.join(roots.select(F.col("node").alias("one"), "root"), "one")
    none = F.lit(None)
    named = at.where("root is not null").select("root", "item", "rank", none.cast("long").alias("n"), none.cast("string").alias("side"),
                                                none.cast("long").alias("other"), none.cast("string").alias("other_side"), none.cast("long").alias("gap"))
    rows = named.unionByName(edges.select("root", F.col("one").alias("item"), none.cast("long").alias("rank"), "n", "side", "other", "other_side", "gap"))
    large = kept(rows.groupBy("root").agg(F.count("*").alias("rows")).where(F.col("rows") > most).select("root"))
    if not large.isEmpty():
        alone = alone.unionByName(rounds.grown(at.join(large, "root", "left_semi").select("item", "rank"), edges.join(large, "root", "left_semi").drop("root")))
        rows = rows.join(large, "root", "left_anti")
    rows = rows.repartition("root").sortWithinPartitions(
        "root", F.col("other").isNotNull(), F.col("rank").asc_nulls_last(), F.col("n").desc(), "item", "other", "other_side", "gap")
    return alone.unionByName(rows.mapInArrow(chains, CHAIN))


def scaffolds(contigs: DataFrame, placed: DataFrame, least: int = 2, limit: int = 8000, inserts: int = 8000) -> DataFrame:
    """scaffold (its seed contig), ordinal, contig_id, direction, gap_before over current contigs; the longest contig seeds first."""
    items = contigs.select(F.col("contig_id").alias("item"), (-F.col("length")).alias("rank"))
    return chained(items, ends(links(placed, limit, inserts)), least).withColumnRenamed("item", "contig_id")


def layout(chains: DataFrame, contigs: DataFrame) -> DataFrame:
    """``chains`` with length, start and finish in the scaffold, and the scaffold's size, gaps and contigs.

    Scaffolds are placed by one running sum over their own contigs.
    """
    line, whole = W.partitionBy("scaffold").orderBy("ordinal"), W.partitionBy("scaffold")
    gap = F.coalesce("gap_before", F.lit(0))
    at = chains.join(contigs.select("contig_id", "length"), "contig_id").withColumn("finish", F.sum(F.col("length") + gap).over(line))
    return at.select("scaffold", "ordinal", "contig_id", "direction", "gap_before", "length", (F.col("finish") - F.col("length") + 1).alias("start"), "finish",
                     F.max("finish").over(whole).alias("size"), F.sum(gap).over(whole).alias("gaps"), F.count("*").over(whole).alias("contigs"))


def agp(laid: DataFrame) -> DataFrame:
    """scaffold, part, line: contig lines (W) and gap lines (N) in order, tab-separated."""
    tab, s = F.lit("\t"), lambda c: (F.col(c) if isinstance(c, str) else c).cast("string")
    name = F.concat(F.lit("scaffold"), s("scaffold"))
    contig = laid.select("scaffold", (F.col("ordinal") * 2 - 1).alias("part"), F.concat_ws("\t", name, s("start"), s("finish"), s(F.col("ordinal") * 2 - 1), F.lit("W"),
                         F.concat(F.lit("contig"), s("contig_id")), F.lit("1"), s("length"), F.when(F.col("direction") == "F", "+").otherwise("-")).alias("line"))
    gap = laid.where("gap_before > 0").select("scaffold", (F.col("ordinal") * 2 - 2).alias("part"), F.concat_ws("\t", name, s(F.col("start") - F.col("gap_before")),
                      s(F.col("start") - 1), s(F.col("ordinal") * 2 - 2), F.lit("N"), s("gap_before"), F.lit("scaffold"), F.lit("yes"), F.lit("paired-ends")).alias("line"))
    return contig.unionByName(gap)


def sequences(laid: DataFrame, consensus: DataFrame) -> DataFrame:
    """scaffold, dna: contigs in order and orientation, gaps as runs of N; ``consensus``: contig_id, dna."""
    from strandlake.functions.sequences import reverse_complement

    at = laid.join(consensus.select("contig_id", "dna"), "contig_id")
    piece = F.concat(F.repeat(F.lit("N"), F.coalesce("gap_before", F.lit(0)).cast("int")), F.when(F.col("direction") == "F", F.col("dna")).otherwise(reverse_complement("dna")))
    return at.groupBy("scaffold").agg(F.array_join(F.array_sort(F.collect_list(F.struct("ordinal", piece.alias("p"))))["p"], "").alias("dna"))


def long_links(laid: DataFrame, placed: DataFrame, inserts: int) -> DataFrame:
    """one, side, other, other_side, template_id: pairs of reads of inserts over ``inserts`` on different scaffolds, each beyond an end."""
    where = laid.select("contig_id", "scaffold", F.col("direction").alias("turn"), F.col("start").alias("s"), F.col("finish").alias("f"), "size")
    at = placed.where(F.col("sihigh") > inserts).join(where, "contig_id")
    forward, plain = F.col("direction") == "Forward", F.col("turn") == "F"
    offset = F.when(plain, F.col("s") - 1 + F.when(forward, F.col("cstart")).otherwise(F.col("cfinish"))).otherwise(F.col("f") - F.when(forward, F.col("cstart")).otherwise(F.col("cfinish")))
    outward = plain == forward
    over = F.when(outward, F.col("sihigh") - (F.col("size") - offset)).otherwise(F.col("sihigh") - offset)
    at = at.where(over > 0).select("template_id", "strand", "scaffold", F.when(outward, "R").otherwise("L").alias("side"))
    f = at.where("strand = 'Forward'").select("template_id", F.col("scaffold").alias("one"), "side")
    r = at.where("strand = 'Reverse'").select("template_id", F.col("scaffold").alias("other"), F.col("side").alias("other_side"))
    pairs = f.join(r, "template_id").where("one <> other").select("one", "side", "other", "other_side", "template_id")
    return pairs.unionByName(pairs.select(F.col("other").alias("one"), F.col("other_side").alias("side"), F.col("one").alias("other"), F.col("side").alias("other_side"), "template_id"))


def superscaffolds(laid: DataFrame, placed: DataFrame, inserts: int, least: int = 2) -> DataFrame:
    """superscaffold (its seed), ordinal, scaffold, direction: scaffolds chained by long inserts; the one of the longest seed contig first."""
    seeds = laid.where(F.col("contig_id") == F.col("scaffold")).select(F.col("scaffold").alias("item"), (-F.col("length")).alias("rank"))
    bridges = long_links(laid, placed, inserts).groupBy("one", "side", "other", "other_side").agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("gap"))
    made = chained(seeds, bridges, least)
    return made.select(F.col("scaffold").alias("superscaffold"), "ordinal", F.col("item").alias("scaffold"), "direction")


def tree(supers: DataFrame, laid: DataFrame) -> DataFrame:
    """superscaffold, document: JSON of superscaffold, scaffolds, contigs and gaps, in order."""
    contig = F.struct("ordinal", "contig_id", "direction", "start", "finish", "gap_before")
    inner = laid.groupBy("scaffold").agg(F.first("size").alias("size"), F.array_sort(F.collect_list(contig)).alias("contigs"))
    at = supers.join(inner, "scaffold").groupBy("superscaffold").agg(F.array_sort(F.collect_list(F.struct("ordinal", "scaffold", "direction", "size", "contigs"))).alias("scaffolds"))
    return at.select("superscaffold", F.to_json(F.struct("superscaffold", "scaffolds")).alias("document"))


def changed_since(contigs: DataFrame, stored: DataFrame) -> DataFrame:
    """project_id, changed: contigs newer than the project's last stored scaffold (project_id, stored), all if there is none."""
    at = contigs.join(stored, "project_id", "left").where("stored is null or created > stored")
    return at.groupBy("project_id").agg(F.count("*").alias("changed"))


def ordered(lists: DataFrame) -> DataFrame:
    """scaffold, ordinal, contig_id, direction of lines ``name<TAB>12+,7-,9``: contigs in order, + or no sign forward."""
    each = lists.select(F.col("name").alias("scaffold"), F.posexplode(F.split("value", r"\s*,\s*")).alias("k", "item")).where(F.col("item").rlike(r"^\d+[+-]?$"))
    return each.select("scaffold", (F.col("k") + 1).cast("long").alias("ordinal"), F.regexp_extract("item", r"\d+", 0).cast("long").alias("contig_id"),
                       F.when(F.col("item").endswith("-"), "R").otherwise("F").alias("direction"))
