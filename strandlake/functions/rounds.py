"""Greedy chains of components too large for a task: plain stretches are contracted, the rest is decided in rounds of bids.

Bridges: one, side, other, other_side, n, gap.  An end of an item is its number and a side, L or R.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.operators.components import components, settled


def opposite(side: str) -> Column:
    return F.when(F.col(side) == "L", "R").otherwise("L")


def plain_links(bridges: DataFrame) -> DataFrame:
    """one, side, other, other_side, gap, back_gap: bridges both of whose ends lead nowhere else and are reached from nowhere else.

    Chains either run over such a link or come round to it from both sides.
    """
    out = bridges.groupBy("one", "side").agg(F.count("*").alias("n_out"), F.first("other").alias("other"), F.first("other_side").alias("other_side"), F.first("gap").alias("gap"))
    into = bridges.groupBy(F.col("other").alias("one"), F.col("other_side").alias("side")).agg(F.count("*").alias("n_in"))
    single = out.join(into, ["one", "side"]).where("n_out = 1 and n_in = 1").drop("n_out", "n_in")
    back = single.select(F.col("one").alias("other"), F.col("side").alias("other_side"), F.col("other").alias("one"), F.col("other_side").alias("side"), F.col("gap").alias("back_gap"))
    return single.join(back, ["one", "side", "other", "other_side"])


def pieces(items: DataFrame, links: DataFrame) -> DataFrame:
    """item, piece, position (from 0), turn (F or R) of every item (item, rank) in its stretch of ``links``.

    A stretch is cut on both sides of its item of lowest rank, the only one that can be a seed: so what is left on each side is always taken
    as a whole, and rings are opened.  Places come from doubling steps along the stretch, so their number grows with its logarithm.
    """
    roots = components(links.select(F.col("one").alias("a"), F.col("other").alias("b"))).withColumnRenamed("node", "item")
    first = items.join(roots, "item").groupBy("root").agg(F.min(F.struct("rank", "item"))["item"].alias("item"))
    inner = links.join(first.select(F.col("item").alias("one")), "one", "left_anti").join(first.select(F.col("item").alias("other")), "other", "left_anti")
    sides = items.select("item", F.explode(F.array(F.lit("L"), F.lit("R"))).alias("side"))
    step = inner.select(F.col("one").alias("item"), "side", F.col("other").alias("to"), opposite("other_side").alias("to_side"))
    at = settled(sides.join(step, ["item", "side"], "left").select(
        "item", "side", F.coalesce("to", "item").alias("to"), F.coalesce("to_side", "side").alias("to_side"), F.col("to").isNotNull().cast("long").alias("dist")))
    while True:
        ahead = at.select(F.col("item").alias("to"), F.col("side").alias("to_side"), F.col("to").alias("next"), F.col("to_side").alias("next_side"), F.col("dist").alias("more"))
        moved = settled(at.join(ahead, ["to", "to_side"]).select("item", "side", F.col("next").alias("to"), F.col("next_side").alias("to_side"), (F.col("dist") + F.col("more")).alias("dist"), "more"))
        at = moved.drop("more")
        if moved.where("more > 0").isEmpty():
            break
    both = at.groupBy("item").agg(*[F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{c}_{s}") for s in "LR" for c in ("to", "dist")])
    left = F.col("to_L") <= F.col("to_R")
    return both.select("item", F.least("to_L", "to_R").alias("piece"), F.when(left, F.col("dist_L")).otherwise(F.col("dist_R")).alias("position"), F.when(left, "F").otherwise("R").alias("turn"))


def contracted(bridges: DataFrame, placed: DataFrame, links: DataFrame) -> DataFrame:
    """one, side, other, other_side, gap, pick: bridges between the outer ends of pieces; ``pick`` orders those of an end, best first."""
    inner = links.select("one", "side", "other", "other_side")
    for way in ("one", "other"):
        inner = inner.join(placed.select(F.col("item").alias(way), F.col("piece").alias(f"{way}_piece")), way)
    outer = bridges.join(inner.where("one_piece = other_piece").drop("one_piece", "other_piece"), ["one", "side", "other", "other_side"], "left_anti")
    outer = outer.withColumn("pick", F.struct((-F.col("n")).alias("n"), F.col("other").alias("item"), F.col("other_side").alias("end"), F.col("gap").alias("least")))
    for way, side in (("one", "side"), ("other", "other_side")):
        outer = outer.join(placed.select(F.col("item").alias(way), "piece", "turn"), way).withColumn(
            side, F.when(F.col("turn") == "F", F.col(side)).otherwise(opposite(side))).drop(way, "turn").withColumnRenamed("piece", way)
    return outer.where("one <> other").select("one", "side", "other", "other_side", "gap", "pick")


CLAIM = ("rank", "seed", "way", "step")


def bids(claims: DataFrame, bridges: DataFrame) -> DataFrame:
    """node and the claim on it: for each open end of a walk its best bridge to a node that no earlier claim holds."""
    seeds, on = F.col("step") == 0, opposite("entered")
    exits = claims.select(F.col("node").alias("one"), *CLAIM, F.explode(F.when(seeds, F.array(F.lit("R"), F.lit("L"))).otherwise(F.array(on))).alias("side")).withColumn(
        "way", F.when(F.col("step") == 0, F.when(F.col("side") == "R", 0).otherwise(1)).otherwise(F.col("way"))).withColumn("step", F.col("step") + 1)
    held = claims.select(F.col("node").alias("other"), F.struct(*CLAIM).alias("held"))
    open_ends = exits.join(bridges, ["one", "side"]).join(held, "other").where(F.col("held") >= F.struct(*CLAIM))
    best = open_ends.groupBy(*CLAIM).agg(F.min(F.struct("pick", "other", F.col("other_side").alias("entered"), F.col("gap").alias("entry_gap"))).alias("b"))
    return best.select(F.col("b.other").alias("node"), *CLAIM, F.col("b.entered").alias("entered"), F.col("b.entry_gap").alias("entry_gap"))


def walks(nodes: DataFrame, bridges: DataFrame) -> DataFrame:
    """node, rank, seed, way (0 right, 1 left), step (0 for the seed), entered (side), entry_gap: the chains of greedy growth over nodes (node, rank, seed).

    Each node claims itself.  In each round every walk bids for its next nodes, a node goes to the bid of the lowest (rank, seed, way, step) or
    back to itself, and what has lost its way to its seed is let go.  The claim of lowest rank never changes again, then that of the next, so
    the only state that stays is that of growing seed by seed; the rounds grow with the longest run of choices that hang on each other.
    """
    own = settled(nodes.select("node", "rank", "seed", F.lit(0).alias("way"), F.lit(0).cast("long").alias("step"), F.lit(None).cast("string").alias("entered"), F.lit(None).cast("long").alias("entry_gap")))
    claims, before = own, None
    line = W.partitionBy("rank", "seed", "way").orderBy("step")
    rest = [c for c in own.columns if c not in ("node", *CLAIM)]
    pack = F.struct(*CLAIM, *rest)
    while True:
        won = own.unionByName(bids(claims, bridges)).groupBy("node").agg(F.min(pack).alias("w")).select("node", "w.*")
        seeds = won.where("step = 0").select("rank", "seed")
        steps = won.where("step > 0").withColumn("k", F.row_number().over(line)).where("k = step").drop("k").join(seeds, ["rank", "seed"], "left_semi")
        whole = steps.unionByName(won.where("step = 0").select(steps.columns))
        lost = own.join(whole.select("node"), "node", "left_anti")
        claims = settled(whole.select(own.columns).unionByName(lost))
        now = claims.agg(F.sum(F.xxhash64(*own.columns).cast("decimal(38,0)"))).first()[0]
        if now == before:
            return claims
        before = now


def grown(items: DataFrame, bridges: DataFrame) -> DataFrame:
    """scaffold, ordinal, item, direction, gap_before: greedy chains of items (item, rank) over bridges, without holding a component in a task."""
    known = items.select(F.col("item").alias("one"))
    strong = settled(bridges.join(known, "one", "left_semi").join(known.withColumnRenamed("one", "other"), "other", "left_semi"))
    links = settled(plain_links(strong))
    placed = settled(pieces(items, links))
    nodes = items.join(placed, "item").groupBy("piece").agg(F.min(F.struct("rank", "item")).alias("m"), F.count("*").alias("size"))
    nodes = settled(nodes.select(F.col("piece").alias("node"), F.col("m.rank").alias("rank"), F.col("m.item").alias("seed"), "size"))
    at = walks(nodes.drop("size"), settled(contracted(strong, placed, links))).join(nodes.select("node", "size"), "node")

    # nodes from left to right: those of the left way backwards, the seed, those of the right way
    line = W.partitionBy("seed").orderBy("order")
    left = F.col("way") == 1
    at = at.withColumn("order", F.when(left, -F.col("step")).otherwise(F.col("step"))).withColumn(
        "direction", F.when((F.col("step") == 0) | (left == (F.col("entered") == "R")), "F").otherwise("R"))
    at = at.withColumn("start", F.sum("size").over(line) - F.col("size")).withColumn(
        "first_gap", F.when(F.col("order") > 0, F.col("entry_gap")).otherwise(F.lag("entry_gap").over(line)))

    # their items in turn; inside a piece each has the gap of the link that the walk ran over
    inside = placed.join(at.select(F.col("node").alias("piece"), "seed", "way", "direction", "start", "size", "first_gap"), "piece")
    ahead = F.col("direction") == "F"
    inside = inside.withColumn("k", F.when(ahead, F.col("position")).otherwise(F.col("size") - 1 - F.col("position"))).withColumn("turned", F.when(F.col("turn") == F.col("direction"), "F").otherwise("R"))
    behind = inside.withColumn("side", F.when(F.col("turned") == "F", "L").otherwise("R"))
    gaps = links.select(F.col("one").alias("item"), "side", "gap", "back_gap")
    inner = F.when(F.col("way") == 1, F.col("gap")).otherwise(F.col("back_gap"))
    return behind.join(gaps, ["item", "side"], "left").select(
        F.col("seed").alias("scaffold"), (F.col("start") + F.col("k") + 1).alias("ordinal"), "item", F.col("turned").alias("direction"), F.when(F.col("k") == 0, F.col("first_gap")).otherwise(inner).alias("gap_before"))
