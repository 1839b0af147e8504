"""Digests once a document; one pile-up for all algorithms; no sort of the rows of a pile by two keys."""

import random

import numpy as np

from strandlake.functions import consensus
from strandlake.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def plan_of(frame) -> str:
    return frame._sc._jvm.PythonSQLUtils.explainString(frame._jdf.queryExecution(), "formatted")


def test_no_letters_travel_to_hashes(spark):
    moved = [block for block in plan_of(QUERIES["sequence_hashes"](spark, DATA)).split("\n\n") if "Exchange\n" in block]
    assert moved and not [block for block in moved if "dna#" in block or "quality#" in block]


def test_one_pile_for_all_algorithms(spark):
    plan = QUERIES["ext_consensus"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow run(contig_id") == 1


def test_events_are_found_without_sorting_rows_twice(monkeypatch):
    rnd, n = random.Random(2), 300
    rows = {"contig_id": [k // 10 for k in range(n)], "seq_id": list(range(n)), "dir": [rnd.choice((1, -1)) for _ in range(n)], "chemistry": [rnd.choice(("a", "b", "Unknown")) for _ in range(n)],
            "dna": [b"\0" + "".join(rnd.choice("ACGTN") for _ in range(30)).encode() for _ in range(n)], "x0": [[rnd.randrange(1, 40)] for _ in range(n)], "y0": [[1]] * n, "y1": [[30]] * n}
    rows["x1"] = [[x[0] + 29] for x in rows["x0"]]
    pile = consensus.Pile(rows, lambda codes, at: (codes.astype(np.int64) * 7 + at * 13) % 41)
    sizes, lexsort = [], np.lexsort
    monkeypatch.setattr(consensus.np, "lexsort", lambda keys: sizes.append(len(keys[0])) or lexsort(keys))
    which, pos, _, _ = consensus.bayes_of(pile)
    known = np.isin(pile.chemistry, [k for k, name in enumerate(pile.kinds) if name != "Unknown"])
    assert sorted(set(zip(pile.which[known], pile.pos[known]))) == list(zip(which, pos)) and max(sizes, default=0) == 0
