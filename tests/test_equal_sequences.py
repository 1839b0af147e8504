"""k-mers of equal sequences: all pairs count, not those of one of each."""

import random
from collections import Counter

import duckdb
import pytest

from strandlake.queries import ORACLES, QUERIES

K = 31


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents that are equal to others, inside of their ids' order, also to a turned one, with repeats of their own, too short, empty or null."""
    rnd, path = random.Random(7), tmp_path_factory.mktemp("equal")
    word = lambda n: "".join(rnd.choice("acgt") for _ in range(n))
    # the letters a, b, c, d stand for A, C, G, T
    text = {"a": "a", "c": "b", "g": "c", "t": "d"}
    made = lambda dna: "".join(text[c] for c in dna)
    shared = word(60)
    one, two = word(40) + shared + word(35), word(20) + shared + shared[:45] + word(10)
    turned = word(15) + shared[::-1].translate(str.maketrans("acgt", "tgca")) + word(30)
    rows = [(1, one), (2, two), (3, one), (4, turned), (5, two), (6, turned), (7, one), (8, word(25)), (9, word(80))]
    rows = [(i, made(t)) for i, t in rows] + [(10, ""), (11, ""), (12, None), (13, "ab"), (14, "ab"), (15, "abcd" * 12), (16, "abcd" * 12)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{path}/documents.parquet")
    return str(path)


def duck(folder, name):
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    found = db.execute(ORACLES[name])
    return [d[0] for d in found.description], sorted(found.fetchall())


def test_offsets_of_all_pairs(spark, folder):
    from strandlake.plans.assembly import Assembly

    dna = {r["seq_id"]: r["dna"] for r in Assembly(spark, folder).dna.collect()}
    turn = lambda t: t[::-1].translate(str.maketrans("ACGT", "TGCA"))
    grams = {i: [(p + 16, t[p : p + K]) for p in range(len(t) - K + 1)] for i, t in dna.items()}
    want = Counter()
    for a in grams:
        for b in grams:
            for p, x in grams[a] if a < b else ():
                for q, y in grams[b]:
                    want[a, b, 1, p - q] += x == y
                    want[a, b, -1, p + q] += x == turn(y)
    found = {tuple(r[c] for c in ("seq_a", "seq_b", "dir", "shift")): r["n"] for r in QUERIES["kmer_offsets"](spark, folder).collect()}
    assert found == {k: n for k, n in want.items() if n >= 3}
    assert found[1, 3, 1, 0] == found[3, 7, 1, 0] == 105 and (2, 5, 1, 0) in found and (5, 7, 1, -20) in found and (15, 16, 1, 4) in found
    columns, theirs = duck(folder, "kmer_offsets")
    assert sorted(tuple(r) for r in QUERIES["kmer_offsets"](spark, folder).select(columns).collect()) == theirs


def test_segments_of_all_pairs(spark, folder):
    columns, theirs = duck(folder, "kmer_segments")
    mine = sorted(tuple(r) for r in QUERIES["kmer_segments"](spark, folder).select(columns).collect())
    assert mine == theirs and {(1, 3), (3, 7), (1, 2), (2, 3), (5, 7), (4, 6), (4, 7), (6, 7), (2, 5)} <= {r[:2] for r in mine}
