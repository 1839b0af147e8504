"""Lines of tags: pairs are made inside of tasks."""

import random

import pytest

from strandlake.functions import tags
from strandlake.queries import QUERIES


def climbed(parent: dict) -> list[tuple]:
    out = []
    for tag in parent:
        at, n = parent[tag], 1
        while at is not None:
            out += [(tag, at, n), (at, tag, -n)]
            at, n = parent.get(at), n + 1
    return sorted(out)


def test_trees_give_all_pairs(spark):
    rnd, parent = random.Random(5), {}
    for tree in range(40):
        for k in range(rnd.randrange(1, 60)):
            parent[tree * 1000 + (k * 37) % 997] = None if not k else tree * 1000 + (rnd.randrange(k) if tree % 2 else k - 1) * 37 % 997
    given = spark.createDataFrame(list(parent.items()), "tag_id long, parent_tag_id long")
    want = climbed(parent)
    assert sorted(map(tuple, tags.lineage(given).collect())) == want
    one = given.na.drop().selectExpr("tag_id", "parent_tag_id as parent")
    assert sorted(map(tuple, tags.descents(tags.rooted(one), nodes=7, rows=5).collect())) == want
    assert tags.lineage(given.limit(0)).count() == 0


def test_a_circle_is_an_error_and_two_precursors_are_not(spark):
    made = lambda rows: spark.createDataFrame(rows, "tag_id long, parent_tag_id long")
    with pytest.raises(ValueError):
        tags.lineage(made([(1, 2), (2, 3), (3, 1)]))
    both = tags.lineage(made([(3, 2), (3, 1), (2, 1)]))
    assert sorted(map(tuple, both.where("generations > 0").collect())) == [(2, 1, 1), (3, 1, 1), (3, 2, 1)]


def test_no_pair_is_shuffled(spark):
    found = QUERIES["tag_lineage"](spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "MapInArrow" in plan.split("Exchange")[0]
