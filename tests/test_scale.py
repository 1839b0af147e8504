"""Work that must grow with the input: rows that joins make, calls of users' functions, passes over the tables."""

import hashlib
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandlake.functions import alignment, consensus, lineage, mappings, reads
from strandlake.plans.assembly import Assembly
from strandlake.queries import QUERIES
from strandlake.sources import exchange

DATA = "/root/testdata/sf0.001"


def joined_rows(spark, work) -> int:
    """Rows that the joins of all jobs in ``work`` put out."""
    store = spark._jsparkSession.sharedState().statusStore()
    before, total = store.executionsCount(), 0
    work()
    runs = store.executionsList()
    for k in range(before, runs.size()):
        run = runs.apply(k).executionId()
        nodes, values = store.planGraph(run).allNodes(), store.executionMetrics(run)
        for node in (nodes.apply(i) for i in range(nodes.size())):
            metrics = node.metrics()
            for m in (metrics.apply(i) for i in range(metrics.size())):
                if "Join" in node.name() and m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    total += int(values.apply(m.accumulatorId()).replace(",", ""))
    return total


def test_a_pair_of_a_chain_is_met_once(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(1, 100)], "contig_id long, parent_id long")
    assert joined_rows(spark, lambda: lineage.relations(edges).count()) <= 2 * (100 * 99 // 2)


def test_shortest_and_longest_ways(spark):
    edges = [(2, 1), (3, 2), (4, 3), (4, 1), (5, 4), (6, 5), (6, 1), (7, 6), (7, 3)]
    want, parents = {}, {}
    for child, parent in edges:
        parents.setdefault(child, []).append(parent)

    def walk(start, now, n):
        for p in parents.get(now, []):
            low, high = want.get((start, p), (n, n))
            want[start, p] = min(low, n), max(high, n)
            walk(start, p, n + 1)

    for c in range(1, 8):
        walk(c, c, 1)
    found = lineage.relations(spark.createDataFrame(edges, "contig_id long, parent_id long")).collect()
    assert {(r["contig_id"], r["relative"]): (r["gen_min"], r["gen_max"]) for r in found} == want


def test_many_contigs_a_call(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        given = [(k // 5, k) for k in range(500)] + [(200, k) for k in range(40)] + [(None, 1)]
        sums = lambda g: g.groupby("contig_id", as_index=False).agg(s=("x", "sum"), calls=("x", "size")).assign(calls=lambda d: [1] + [0] * (len(d) - 1))
        out = reads.processed(spark.createDataFrame(given, "contig_id long, x long"), sums, "contig_id long, s long, calls long", together=True).toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = pd.DataFrame(given, columns=["contig_id", "x"]).dropna().groupby("contig_id")["x"].sum()
    assert len(out) == 101 and dict(zip(out["contig_id"], out["s"])) == want.to_dict() and out["calls"].sum() < 101


def test_placements_read_the_reads_once(spark):
    plan = Assembly(spark, DATA).segment._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lineitem.parquet") + plan.count("l_orderkey#") > 0 and "Union" not in plan


@pytest.mark.parametrize("letters", ["ACGT", "ACGTNXé*"])
def test_whole_contigs_are_called_like_rows(spark, letters):
    rng = random.Random(7)
    dna = {s: "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 7, 20, 33]))) for s in range(40)}
    quality = lambda codes, at: (codes.astype(int) * 5 + at * 3) % 110 - 2
    code = lambda text: np.frombuffer(text.encode("latin-1", "replace"), np.uint8)
    segments, maps = [], []
    for s in dna:
        for contig in {rng.randrange(6), rng.randrange(6)}:
            way, x = rng.choice([1, -1]), rng.randrange(1, 30)
            xs = [(x, x + 9), (x + 10 + rng.randrange(4), 0)]
            xs[1] = (xs[1][0], xs[1][0] + 9)
            ys = [(1, 10), (11, 20)] if way == 1 else [(11, 20), (1, 10)]
            segments += [(contig, s, *a, *b, way) for a, b in zip(xs, ys)]
            maps.append((contig, s, way, ["Unknown", "p", "t", None][s % 4], *([v[i] for v in side] for side in (xs, ys) for i in (0, 1))))
    reads_ = [(s, t, [int(v) for v in quality(code(t), np.arange(1, len(t) + 1))], ["Unknown", "p", "t", None][s % 4]) for s, t in dna.items()]
    piled = consensus.pileup(spark.createDataFrame(segments, "contig_id long, seq_id long, x0 long, x1 long, y0 long, y1 long, dir int"),
                             spark.createDataFrame(reads_, "seq_id long, dna string, quality array<int>, chemistry string")).cache()
    packed = consensus.packed_letters(spark.createDataFrame(list(dna.items()), "seq_id long, dna string"))
    placed = spark.createDataFrame(maps, "contig_id long, seq_id long, dir int, chemistry string, x0 array<long>, x1 array<long>, y0 array<long>, y1 array<long>").join(packed, "seq_id").cache()
    sums = piled.groupBy("contig_id", "base", "strand").agg(F.count("*").alias("n"), F.sum("q").alias("quality"), F.min("pos").alias("first_base"), F.max("pos").alias("last_base"))
    assert sorted(consensus.pile_sums(placed, quality).collect()) == sorted(sums.collect())
    for name in ("vote", "bayes"):
        want = {r["contig_id"]: (r["dna"], r["quality"]) for r in consensus.assembled(consensus.called(piled, name)).collect()}
        assert {r["contig_id"]: (r["dna"], r["quality"]) for r in consensus.consensus(placed, name, quality).collect()} == want


@pytest.mark.parametrize("name", ["pileup", "consensus_vote"])
def test_no_row_a_position_is_shuffled(spark, name):
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "posexplode" not in plan and "quality" not in "".join(line for line in plan.splitlines() if "Exchange" in line)


def test_blocks_of_reads_take_one_pass(spark):
    contigs = spark.createDataFrame([("c", "AC", [1, 2]), ("d", None, None)], "name string, dna string, quality array<int>")
    segments = spark.createDataFrame([("c", "r", 1, 2, 1, 2)], "name string, read string, cstart long, cfinish long, rstart long, rfinish long")
    reads_ = spark.range(2).selectExpr("concat('r', id) as name", "'t' as template", "'Forward' as strand", "1 as si_low", "2 as si_high", "cast(null as int) as qleft", "3 as qright", "if(id = 0, 'ACG', null) as dna", "array(4, 5, 6) as quality")
    out = exchange.caf(contigs, segments, reads_)
    assert out._jdf.queryExecution().executedPlan().toString().count("Range (0, 2") == 1
    want = ["Sequence : c", "Sequence : d", "DNA : c", "BaseQuality : c", "Sequence : r0", "Sequence : r1", "DNA : r0", "BaseQuality : r0"]
    assert sorted(r["block"].split("\n")[0] for r in out.collect()) == sorted(want)


def test_steps_end_with_their_pairs(monkeypatch):
    rng, rows = random.Random(3), []
    dna = ["".join(rng.choice("ACGT") for _ in range(n)) for n in (900, 30, 30, 30)]
    next_row = alignment.Matrix.next
    monkeypatch.setattr(alignment.Matrix, "next", lambda self, before, *how: rows.append(len(before)) or next_row(self, before, *how))
    codes = [alignment.codes(x) for x in dna]
    score, *_ = alignment.Matrix(codes, codes, [0] * 4, 4).best()
    assert list(score) == [900, 30, 30, 30] and sum(rows) == 990


def plan_of(frame) -> str:
    return frame._sc._jvm.PythonSQLUtils.explainString(frame._jdf.queryExecution(), "formatted")


def test_keys_of_an_anti_join_are_not_gathered(spark):
    plan = QUERIES["chk_seq2read"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan and "SortAggregate" not in plan and plan.count("Window [") <= 3
    versions = Assembly(spark, DATA).version
    assert versions.where("version = 1").count() == spark.read.parquet(f"{DATA}/lineitem.parquet").where("l_tax > 0.04").count() > 0


@pytest.mark.parametrize("name", ["read_versions", "map_transform_string"])
def test_letters_and_digests_meet_reads_by_document(spark, name):
    plan = plan_of(QUERIES[name](spark, DATA))
    moved = [block for block in plan.split("\n\n") if "Exchange\n" in block and "dna#" in block]
    assert all("__doc" in block or "BroadcastExchange" in block for block in moved)
    joins = [block for block in plan.split("\n\n") if "Join" in block.split("\n")[0] and "Left keys" in block and ("readname" in block or "seq_id" in block)]
    assert len(joins) <= 1


def test_versions_of_equal_and_new_sequences(spark):
    given = spark.createDataFrame([("r", "h1", "q"), ("r", "h1", "q"), ("r", "h1", "p"), ("n", "x", "y"), (None, "h1", "q"), ("r", None, "q")], "readname string, seq_hash string, qual_hash string")
    stored = spark.createDataFrame([("r", 0, "h0", "q"), ("r", 2, "h1", "q"), ("r", 1, "h1", "q"), (None, 4, "h1", "q"), ("r", 3, None, "q")], "readname string, version int, seq_hash string, qual_hash string")
    found = sorted(map(str, map(tuple, reads.versions_matched(given, stored).collect())))
    assert found == sorted(map(str, [("r", 1, False), ("r", 1, False), ("r", 4, True), ("n", 0, True), (None, 0, True), ("r", 4, True)]))


def test_carried_stops_at_the_end_of_the_string(spark):
    pieces = spark.createDataFrame([(9, 1, 11, 15, 1, 5, -1), (9, 1, 1, 6, 6, 11, -1), (8, 1, 5, 6, 9, 10, -1), (8, 1, 1, 3, 6, 8, 1)], "contig_id long, seq_id long, x0 long, x1 long, y0 long, y1 long, dir int")
    found = {r["contig_id"]: r["carried"] for r in mappings.carried(pieces, spark.createDataFrame([(1, "AACCGTTA")], "seq_id long, dna string")).collect()}
    assert found == {9: "TAA" + "-" * 4 + "CGGTT", 8: "TTA-"}


def test_imported_names_carry_no_letters(spark):
    fasta = spark.createDataFrame([("old", "AC"), ("t.1", "ACGT"), ("t.1", "GG"), ("u", "A")], "name string, dna string")
    known, templates = spark.createDataFrame([("old",), (None,)], "readname string"), spark.createDataFrame([("t", 40)], "name string, template_id long")
    made = reads.imported_consensus(fasta, known, templates)
    assert all("dna#" not in block for block in plan_of(made["reads"]).split("\n\n") if "Exchange" in block)
    best = min((hashlib.md5(d.encode()).hexdigest(), d) for d in ("ACGT", "GG"))
    assert sorted(map(tuple, made["reads"].select("readname", "template", "length", "seq_hash").collect()))[0] == ("t.1", "t", len(best[1]), best[0])
    assert {r["readname"]: r["dna"] for r in made["sequence"].collect()} == {"t.1": best[1], "u": "A"}
    assert [(r["template"], r["template_id"]) for r in made["template"].collect()] == [("u", 41)]


def test_a_text_of_many_contigs_is_wrapped_once(spark, monkeypatch):
    seen, write = [], exchange.write_wrapped
    monkeypatch.setattr(exchange, "write_wrapped", lambda rows, path: seen.append(rows._jdf.queryExecution().optimizedPlan().toString()) or write(rows, path))
    assert QUERIES["sink_fasta"](spark, DATA).count() > 0
    above = seen[0].split("Join Inner")[0]
    assert "regexp_replace" in seen[0] and "regexp_replace" not in above


def test_placements_of_current_contigs_number_the_reads_once(spark):
    plan = Assembly(spark, DATA).place._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("row_number()") == 1
