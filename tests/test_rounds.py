"""Greedy chains in rounds against the plain greedy."""

import random

import pytest
from pyspark.sql import functions as F

from strandlake.functions import rounds, scaffolds
from strandlake.operators.components import components
from tests.test_functions import plain_chains, rows

BRIDGES = "one long, side string, other long, other_side string, n long, gap long"


def both_ways(links: dict) -> list[tuple]:
    return [(*k, *v) for k, v in links.items()]


def random_links(rng: random.Random, nodes: int, edges: int, one_way: float = 0.0) -> dict:
    """Bridges that lead back with a gap of their own, some of them one way only."""
    links = {}
    for _ in range(edges):
        a, b, s, t = rng.randrange(nodes), rng.randrange(nodes), rng.choice("LR"), rng.choice("LR")
        if a != b:
            n = rng.randint(1, 4)
            links[a, s, b, t] = (n, rng.randint(1, 50))
            if rng.random() >= one_way:
                links[b, t, a, s] = (n, rng.randint(1, 50))
    return links


@pytest.mark.parametrize(("seed", "nodes", "edges", "one_way"), [(2, 40, 90, 0), (3, 80, 70, 0.2)])
def test_random_graphs(spark, seed, nodes, edges, one_way):
    rng = random.Random(seed)
    items = [(i, -rng.randint(1, 9)) for i in range(nodes)]
    bridges = both_ways(random_links(rng, nodes, edges, one_way))
    made = scaffolds.chained(spark.createDataFrame(items, "item long, rank long"), spark.createDataFrame(bridges, BRIDGES), 2, most=0)
    assert rows(made) == plain_chains(items, bridges, 2)


def stretches(rng: random.Random) -> tuple[list, list]:
    """Rings, open lines and lines that end in forks, with turned items."""
    links, items, at = {}, [], 0
    for kind in ("ring", "line", "fork", "ring", "line", "fork"):
        size = rng.randint(2, 9)
        names = list(range(at, at + size))
        rng.shuffle(names)
        at += size
        items += [(i, rng.randint(1, 5)) for i in names]
        turned = {i: rng.random() < 0.5 for i in names}
        out, into = (lambda i, t=turned: "L" if t[i] else "R"), (lambda i, t=turned: "R" if t[i] else "L")
        for a, b in zip(names, names[1:], strict=False):
            links[a, out(a), b, into(b)] = (3, rng.randint(1, 50))
            links[b, into(b), a, out(a)] = (3, rng.randint(1, 50))
        first, last = names[0], names[-1]
        if kind == "ring" and size > 2:
            links[last, out(last), first, into(first)] = (2, rng.randint(1, 50))
            links[first, into(first), last, out(last)] = (2, rng.randint(1, 50))
        if kind == "fork":
            for k in range(2):
                items.append((at, rng.randint(1, 5)))
                links[last, out(last), at, "L"] = links[at, "L", last, out(last)] = (2 + k, rng.randint(1, 50))
                links[at, "R", first, into(first)] = links[first, into(first), at, "R"] = (2, rng.randint(1, 50))
                at += 1
    return items, both_ways(links)


def test_rings_lines_and_forks(spark):
    items, bridges = stretches(random.Random(5))
    made = scaffolds.chained(spark.createDataFrame(items, "item long, rank long"), spark.createDataFrame(bridges, BRIDGES), 2, most=0)
    assert rows(made) == plain_chains(items, bridges, 2)


def test_long_chain(spark):
    """A line of 5,000 items whose numbers are shuffled: one chain from its seed in the middle; none of its items meets another but by its links."""
    n = 5_000
    name = lambda c: ((c * 1_009) % n).cast("long")
    line = spark.range(n - 1).select(name(F.col("id")).alias("one"), F.lit("R").alias("side"), name(F.col("id") + 1).alias("other"), F.lit("L").alias("other_side"), F.lit(2).cast("long").alias("n"), (F.col("id") % 50).alias("gap"))
    back = line.select(F.col("other").alias("one"), F.col("other_side").alias("side"), F.col("one").alias("other"), F.col("side").alias("other_side"), "n", "gap")
    items = spark.range(n).select(name(F.col("id")).alias("item"), F.abs(F.col("id") - n // 2).alias("rank"))
    made = scaffolds.chained(items, line.unionByName(back), 2, most=1_000)
    found = made.agg(F.count("*"), F.count_distinct("scaffold"), F.min("scaffold"), F.sum((F.col("item") == name(F.col("ordinal") - 1)).cast("long")),
                     F.sum((F.col("gap_before") == (F.col("ordinal") - 2) % 50).cast("long")), F.sum((F.col("direction") == "F").cast("long"))).first()
    assert tuple(found) == (n, 1, (n // 2 * 1_009) % n, n, n - 1, n)


def test_few_rounds_on_long_paths(spark, monkeypatch):
    """Components of a path with shuffled names: rounds grow with the logarithm of its length."""
    n, calls = 3_000, []
    from strandlake.operators import components as module

    plain = module.settled
    monkeypatch.setattr(module, "settled", lambda df: calls.append(1) or plain(df))
    path = spark.range(n - 1).select(((F.col("id") * 1_009) % n).alias("a"), (((F.col("id") + 1) * 1_009) % n).alias("b"))
    assert components(path).where("root <> 0").isEmpty() and len(calls) < 40


def test_empty_and_alone(spark):
    items = spark.createDataFrame([(1, 1), (2, 0)], "item long, rank long")
    none = spark.createDataFrame([], BRIDGES)
    assert rows(rounds.grown(items, none)) == [(1, 1, 1, "F", None), (2, 1, 2, "F", None)]
    assert rows(rounds.grown(items.limit(0), none)) == []
