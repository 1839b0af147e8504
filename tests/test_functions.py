"""Operators against hand-computed values and plain Python on small fixtures with nulls, ties and empty tables."""

import hashlib
import random
from datetime import date

import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandlake.functions import alignment, consensus, integrity, joins, kmers, lineage, mappings, reads, scaffolds, selections, sequences, statistics, tags
from strandlake.sources import exchange, files, tables
from strandlake.streaming.increments import follow, increment

SEG = "contig_id long, seq_id long, x0 long, x1 long, y0 long, y1 long, dir int"
READS = "seq_id long, dna string, quality array<int>, chemistry string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def one(spark, expression, dna):
    return spark.createDataFrame([(dna,)], "dna string").select(expression).first()[0]


def test_scalar_functions(spark):
    assert one(spark, sequences.stripped("dna"), "aNx*-Xnc") == "ac"
    assert one(spark, sequences.n_to_x("dna", 3), "ANTNNGNNNC?A") == "ANTNNGXXXCNA"
    assert one(spark, sequences.masked("dna", F.lit(2), F.lit(5)), "ACGTACGT") == "XXGTXXXX"
    assert one(spark, sequences.masked("dna", F.lit(9), F.lit(1)), "ACG") == "XXG"
    assert one(spark, sequences.masked("dna", F.lit(0), F.lit(9)), "") == ""
    assert one(spark, sequences.unmasked("dna", F.lit("acgtacgt")), "XXGTnnnx") == "acGTacgt"
    assert one(spark, sequences.unmasked("dna", F.lit(None).cast("string")), "XXGT") == "XXGT"
    assert one(spark, sequences.unmasked("dna", F.lit("acgt")), "XXXX") == "acgt"
    assert one(spark, sequences.end_regions("dna", 2, short=1), "ACGTACGT") == "ACNGT"
    assert one(spark, sequences.reverse_complement("dna"), "ACgtN-") == "-NacGT"
    assert one(spark, sequences.reverse_complement("dna"), None) is None


def test_quality_clip_is_the_loop(spark):
    rng = random.Random(2)
    arrays = [[rng.randint(0, 40) for _ in range(rng.randint(1, 60))] for _ in range(40)] + [[15] * 4, [40] * 5]
    bases = spark.createDataFrame([(k, i + 1, "A", q) for k, a in enumerate(arrays) for i, q in enumerate(a)], "seq_id long, pos long, base string, q int")
    want = []
    for k, a in enumerate(arrays):
        sums = [[0] * len(a), [0] * len(a)]
        for way, places in enumerate((range(len(a)), range(len(a) - 1, -1, -1))):
            run = 0
            for i in places:
                run = max(0, run + a[i] - 15)
                sums[way][i] = run
        both = [x + y for x, y in zip(*sums)]
        if max(both) > 0:
            at = both.index(max(both))
            left = max((i + 1 for i in range(at + 1) if sums[0][i] == 0), default=0) + 1
            right = min((i + 1 for i in range(at, len(a)) if sums[1][i] == 0), default=len(a) + 1) - 1
            want.append((k, left, right))
    assert rows(sequences.quality_clips(bases)) == sorted(want, key=str)


def test_digest_strips_and_reads_iupac(spark):
    found = sequences.digest(spark.createDataFrame([(1, "nnGA-ATTCgantcGAATTC"), (2, None), (3, "")], "seq_id long, dna string"), {"EcoRI": "GAATTC", "HinfI": "GANTC"})
    assert rows(found) == [(1, 1, "EcoRI", 10), (1, 11, "EcoRI", None)]


PILE_SEGMENTS = [(1, 1, 1, 3, 1, 3, 1), (1, 1, 5, 6, 4, 5, 1), (1, 2, 2, 5, 1, 4, -1), (1, 3, 1, 9, 1, 9, 1), (2, 4, 1, 2, 1, 2, 1)]
PILE_READS = [(1, "ACGTA", [10, 20, 30, 9, 20], "Dye_primer"), (2, "acgt", [5, 0, 7, 8], "Dye_terminator"), (3, "GG", [1, 120], "Unknown"), (4, None, None, "Dye_primer")]


def test_pileup_complements_and_pads(spark):
    found = consensus.pileup(spark.createDataFrame(PILE_SEGMENTS, SEG), spark.createDataFrame(PILE_READS, READS))
    got = sorted((r["seq_id"], r["pos"], r["base"], r["q"], r["strand"][0]) for r in found.collect())
    assert got == [
        (1, 1, "A", 10, "F"), (1, 2, "C", 20, "F"), (1, 3, "G", 30, "F"), (1, 4, "*", 20, "F"), (1, 5, "T", 9, "F"), (1, 6, "A", 20, "F"),
        (2, 2, "A", 8, "R"), (2, 3, "C", 7, "R"), (2, 5, "T", 5, "R"), (3, 1, "G", 1, "F"), (3, 2, "G", 120, "F"),
    ]  # the pad runs from 30 to 9: 30 + trunc(-21 * 1 / 2)


def plain_bayes(pile):
    bonus = (0, 0, 7, 14, 21, 28, 35, 41, 45, 58, 49)
    hi, n, forced = {}, {}, None
    for base, q, strand, chemistry in pile:
        if chemistry == "Unknown":
            continue
        base = base if base in "ACGT*" else "-"
        q = 2 if q == 1 else q
        forced = base if q >= 100 else forced
        hi[base, strand, chemistry] = max(hi.get((base, strand, chemistry), 0), q)
        n[base, strand, chemistry] = n.get((base, strand, chemistry), 0) + 1
    if not n:
        return None
    if forced:
        return forced, 0 if forced == "-" else 100
    classes = "ACGT*" if any(b == "*" for b, *_ in n) else "ACGT"
    p = dict.fromkeys(classes, 1.0)
    for (base, s, c), k in n.items():
        good = 1 - 10 ** (-(hi[base, s, c] + bonus[min(k, 10)]) / 10)
        for x in classes:
            p[x] *= 1.0 if base == "-" else good if x == base else (1 - good) / (len(classes) - 1)
    best = max(classes, key=lambda x: p[x])
    rest = sum(p.values()) - p[best]
    share = rest / sum(p.values())
    score = 99 if share <= 1e-10 else min(99, int(-10 * __import__("math").log10(share) + 0.5001))
    return ("-", 2) if best != "*" and score < 2 else (best, score)


def test_consensus_rules(spark):
    rng = random.Random(6)
    pile = [(c, p, rng.choice("AACGT*N"), rng.choice([1, 3, 9, 20, 40]), rng.choice(["Forward", "Reverse"]), rng.choice(["Dye_primer", "Dye_terminator", "Unknown"]), s)
            for c in (1, 2) for p in range(40) for s in range(rng.randint(1, 8))] + [(3, 1, "A", 100, "Forward", "Dye_primer", 1), (3, 1, "-", 120, "Forward", "Dye_primer", 2), (3, 2, "N", 9, "Forward", "Dye_primer", 1)]
    df = spark.createDataFrame(pile, "contig_id long, pos long, base string, q int, strand string, chemistry string, seq_id long")
    at = {}
    for c, p, *rest, s in pile:
        at.setdefault((c, p), []).append(tuple(rest))
    want = {k: r for k, v in at.items() if (r := plain_bayes(v))}
    assert {(r["contig_id"], r["pos"]): (r["base"], r["score"]) for r in consensus.bayes(df).collect()} == want
    votes = {}
    for k, v in at.items():
        sums = {c: sum(q for b, q, *_ in v if b == c) for c in "ACGT*"}
        if max(sums.values()):
            votes[k] = max("ACGT*", key=lambda c: sums[c]), max(sums.values())
    assert {(r["contig_id"], r["pos"]): (r["base"], r["score"]) for r in consensus.vote(df).collect()} == votes
    consensus.ALGORITHMS["first"] = consensus.per_position(lambda g: (g["base"].iloc[0], len(g)))
    mine = {(r["contig_id"], r["pos"]): (r["base"], r["score"]) for r in consensus.called(df, "first").collect()}
    assert mine == {k: (v[0][0], len(v)) for k, v in at.items()}
    with pytest.raises(ValueError):
        consensus.called(df, "none")
    assert consensus.bayes(df.limit(0)).count() == consensus.vote(df.limit(0)).count() == 0


def test_mapping_algebra(spark):
    seg = spark.createDataFrame([(1, 1, 1, 10, 101, 110, 1), (1, 1, 13, 20, 111, 118, 1), (1, 2, 5, 9, 1, 5, -1), (2, 1, 31, 40, 101, 110, -1), (2, 1, 21, 28, 111, 118, -1), (3, 1, 11, 20, 101, 110, 1)], SEG)
    same = {tuple(r) for r in mappings.inverse(mappings.inverse(seg)).select(seg.columns).collect()}
    assert same == {tuple(r) for r in seg.collect()}
    back = mappings.multiplied(seg, seg).where("contig_id = contig_2")
    assert all(r["x0"] == r["y0"] and r["x1"] == r["y1"] and r["dir"] == 1 for r in back.collect()) and back.count() == 6
    assert rows(mappings.equal(seg, seg).where("contig_id < contig_id_2")) == [(1, 1, 2, 1, -1, 41)]
    assert rows(mappings.joined(spark.createDataFrame([(1, 1, 1, 5, 1, 5, 1), (1, 1, 6, 9, 6, 9, 1), (1, 1, 20, 22, 20, 22, 1)], SEG)).select("x0", "x1", "parts")) == [(1, 9, 2), (20, 22, 1)]
    assert rows(mappings.extended(seg.where("seq_id = 2"), 1, 12).select("x0", "x1", "y0", "y1")) == [(1, 12, -2, 9)]
    at = spark.createDataFrame([(1, 6), (1, 11), (1, 20)], "contig_id long, pos long")
    assert rows(mappings.lifted(seg.where("contig_id = 1"), at).select("seq_id", "pos", "y")) == [(1, 20, 118), (1, 6, 106), (2, 6, 4)]
    ends = spark.createDataFrame([(1, 1, 10, 1, 5, 14), (1, 1, 20, 20, 4, 4)], "contig_id long, seq_id long, x_first long, x_last long, y_first long, y_last long")
    assert rows(mappings.normalised(mappings.from_ends(ends)).select("dir", "x0", "x1", "y0", "y1", "reason")) == [(-1, 1, 20, 4, 14, "regular")]


def test_deep_lineage(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(1, 1000)] + [(1000, 1), (5, None)], "contig_id long, parent_id long")
    closure = lineage.relations(edges)
    assert closure.count() == 1000 * 999 // 2
    far = closure.where("contig_id = 1000 and relative = 1").first()
    assert (far["gen_min"], far["gen_max"]) == (1, 999)
    old = spark.createDataFrame([(1000,)], "contig_id long")
    assert rows(lineage.at_age(old, edges, 998)) == [(2,)]
    assert {r["contig_id"]: r["age"] for r in lineage.ages(old, edges).collect()} == {i: 1000 - i for i in range(1, 1001)}
    assert lineage.relations(edges.limit(0)).count() == 0 and rows(lineage.ages(old, edges.limit(0))) == [(1000, 0)]
    for loop in ([(1, 2), (2, 1)], [(1, 2), (2, 3), (3, 4), (4, 2), (5, 4)]):
        for check in (lineage.relations, lambda e: lineage.ages(old, e)):
            with pytest.raises(ValueError):
                check(spark.createDataFrame(loop, "contig_id long, parent_id long")).count()


def test_ages_of_branching_lineages(spark):
    rng = random.Random(3)
    pairs = [(a, b) for a in range(60, 1, -1) for b in rng.sample(range(1, a), min(a - 1, rng.choice([1, 1, 1, 2, 3])))] + [(100, 60), (61, 30)] + [(200, 201 + i) for i in range(50)]
    current = [100, 200, 300, 45]  # 61 has no child but isn't current; 45 is an ancestor and stays at least 0
    age = {c: 0 for c in current}
    for _ in range(70):
        for a, b in pairs:
            if a in age:
                age[b] = max(age.get(b, 0), age[a] + 1)
    found = lineage.ages(spark.createDataFrame([(c,) for c in current] * 2, "contig_id long"), spark.createDataFrame(pairs + pairs[:9], "contig_id long, parent_id long"))
    assert {r["contig_id"]: r["age"] for r in found.collect()} == age


def unruly_pair(shifts, width=30):
    """Mappings of contigs 2 (child) and 1 (parent) with one read a shift, at the places that are given."""
    rows = []
    for i, (place, shift) in enumerate(shifts):
        rows += [(2, i, "Forward", place, place + width - 1), (1, i, "Forward", place - shift, place - shift + width - 1)]
    return rows


def test_unruly_links(spark):
    m, pair = "contig_id long, seq_id long, direction string, cstart long, cfinish long", spark.createDataFrame([(2, 1)], "contig_id long, parent_id long")
    link = lambda rows, **how: lineage.link_contigs(spark.createDataFrame(rows, m), pair, least_reads=1, **how)
    bad = lambda rows, **how: rows_of(lineage.unruly(lineage.shared_reads(spark.createDataFrame(rows, m), pair).withColumn("bases", F.lit(30)), **how))
    rows_of = lambda df: [tuple(r) for r in df.collect()]
    zigzag = unruly_pair([(100 + 1000 * (i % 2) + 40 * i, s) for i, s in enumerate([-30, -20, -10, 0, 1, 2, 10, 20, 30])])
    assert bad(zigzag) == [(2, 1, 1)]  # 7 turns, no correlation
    assert bad(zigzag, defects=7) == [] and bad(zigzag, defects=6) == [(2, 1, 1)]  # on both sides of the number of turns
    assert bad(zigzag, window=61) == [] and bad(zigzag, window=60) == [(2, 1, 1)]  # and of the spread
    places, shifts = [r[3] for r in zigzag[::2]], [-30, -20, -10, 0, 1, 2, 10, 20, 30]
    mid = [p + 14.5 for p in places]
    r = abs(sum(p * s for p, s in zip(mid, shifts)) / (sum(p * p for p in mid) * sum(s * s for s in shifts)) ** 0.5)
    assert bad(zigzag, correlation=r + 1e-9) == [(2, 1, 1)] and bad(zigzag, correlation=r - 1e-9) == []
    steady = unruly_pair([(100 + 50 * i, s) for i, s in enumerate([-30, -20, -10, 0, 1, 2, 10, 20, 30])])
    assert bad(steady) == []  # no turn
    kept = sorted(r["shift"] for r in link(zigzag, window=40).collect())
    assert kept == [-10, 0, 2, 20]  # -30, -20 and 30 are too far, and mark 100 to 1169; 1 and 10 lie inside it, as does -10, the first
    assert link(zigzag).count() == link(steady, window=40).count() == 9


def test_moves_are_audited(spark):
    moves = spark.createDataFrame([(1, 5, "ann"), (2, 5, "ann"), (3, 5, "bob"), (4, 9, "bob"), (6, 5, "bob")], "contig_id long, new_project_id long, who string")
    contigs = spark.createDataFrame([(1, 4), (2, 5), (3, 4), (4, 4)], "contig_id long, project_id long")
    current = contigs.where("contig_id <> 3")
    projects = spark.createDataFrame([(4,), (5,)], "project_id long")
    assert rows(lineage.audit_rows(moves, contigs, current, projects)) == [(1, 4, 5, "ann")]


def test_free_reads_of_ligations(spark):
    reads_ = spark.createDataFrame([(1, 11), (2, 12), (3, 13), (4, None)], "read_id long, template_id long")
    placed = spark.createDataFrame([(2,)], "seq_id long")
    templates = spark.createDataFrame([(11, 1), (12, 1), (13, 2)], "template_id long, ligation_id long")
    chosen = spark.createDataFrame([(1,), (1,)], "ligation_id long")
    from strandlake.functions import placements

    assert [r["read_id"] for r in placements.free_by_ligation(reads_, placed, templates, chosen).collect()] == [1]
    assert sorted(r["read_id"] for r in placements.free_by_ligation(reads_, placed, templates, chosen, complement=True).collect()) == [3, 4]


def test_content_checksums(spark):
    row = lineage.content_checksums(spark.createDataFrame([(1, "AACG", [3, 2, 1]), (2, None, None)], "seq_id long, dna string, quality array<int>")).orderBy("seq_id").collect()
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    assert tuple(row[0]) == (1, md5("AACG"), md5("CGTT"), md5("3,2,1"), md5("1,2,3")) and tuple(row[1]) == (2, None, None, None, None)


def test_links_are_pruned(spark):
    made = [(2, 1, 1, s, 1, 1, a, b) for s, a, b in [(0, 1, 100), (5, 20, 60), (7, 90, 150), (9, 90, 150), (3, 151, 170), (4, 170, 200)]]
    found = lineage.pruned_links(spark.createDataFrame(made, "contig_id long, parent_id long, dir int, shift long, part long, nreads long, cstart long, cfinish long"))
    # 90-100 is shared by 6 each, 170 by one each; the inner one and the second of two equal ones go
    assert rows(found.select("shift", "cstart", "cfinish")) == [(0, 1, 94), (3, 151, 169), (4, 171, 200), (7, 96, 150)]


def test_links_and_load(spark):
    m = "contig_id long, seq_id long, direction string, cstart long, cfinish long"
    stored = spark.createDataFrame([(1, s, "Forward", 10 * s, 10 * s + 20) for s in range(1, 7)], m)
    child = spark.createDataFrame([(9, s, "Reverse", 200 - 10 * s - 20, 200 - 10 * s) for s in range(1, 6)] + [(9, 6, "Forward", 400, 420)], m)
    pair = spark.createDataFrame([(9, 1)], "contig_id long, parent_id long")
    links = lineage.link_contigs(stored.unionByName(child), pair, least_reads=1).collect()
    assert [(r["dir"], r["shift"], r["nreads"], r["cstart"], r["cfinish"]) for r in links] == [(-1, 200, 5, 130, 190)]
    contigs = spark.createDataFrame([(1, 7, 6, 80, date(2000, 1, 1))], "contig_id long, project_id long, nreads int, length long, created date")
    none = spark.createDataFrame([], "contig_id long, parent_id long")
    new = child.unionByName(stored.selectExpr("contig_id + 4 as contig_id", "seq_id", "direction", "cstart + 3 as cstart", "cfinish + 3 as cfinish")).unionByName(spark.createDataFrame([(8, 99, "Forward", 1, 5)], m))
    got = {r["contig_id"]: (r["outcome"], r["same_as"], r["parents"], r["project_id"]) for r in lineage.load(new, stored, contigs, none, 3).collect()}
    assert got == {9: ("loaded", None, "1", 7), 5: ("duplicate", 1, "1", 7), 8: ("loaded", None, "", 3)}
    verdicts = spark.createDataFrame([(9, 1, 6, 80), (8, 1, 2, 80), (7, 1, 4, 80), (6, 2, 1, 10), (5, 2, 1, 90)], "contig_id long, parent_id long, shared long, overlap long")
    size = spark.createDataFrame([(9, 6, 0), (8, 30, 0), (7, 30, 0), (6, 30, 0), (5, 30, 0), (1, 20, 90), (2, 2, 100)], "contig_id long, nreads int, length long")
    assert [v for *_, v in rows(lineage.valid_links(verdicts, size).select("contig_id", "verdict"))] == [1, 0, 0, 0, 1]
    state = lineage.repaired(pair.unionByName(spark.createDataFrame([(5, 4)], pair.schema)), spark.createDataFrame([(9, 1), (8, 2)], pair.schema))
    assert rows(state) == [(5, 4, "invalid"), (8, 2, "missing"), (9, 1, "confirmed")]


def test_statistics(spark):
    rng = random.Random(4)
    sizes = [(k, rng.randint(1, 30)) for k in (1, 2, 3) for _ in range(25)] + [(4, 0)]
    found = dict(rows(statistics.n50(spark.createDataFrame(sizes, "k long, length long"), "k")))
    for k in (1, 2, 3, 4):
        mine, run = sorted((n for g, n in sizes if g == k), reverse=True), 0
        want = 0
        for n in mine:
            run += n
            if run > sum(mine) // 2:
                want = n
                break
        assert found[k] == want
    days = [(date(2000, 1, 1 + d), rng.randint(1, 9)) for d in range(20)]
    frame = spark.createDataFrame([(d,) for d, n in days for _ in range(n)] + [(None,)], "asped date")
    run, batch, want = 0, 0, []
    for d, n in days:
        run += n
        want.append((d, n, batch))
        if run > 12:
            run, batch = 0, batch + 1
    assert [tuple(r) for r in statistics.read_batches(frame, 12).orderBy("asped").collect()] == want
    contigs = spark.createDataFrame([(1, 1, date(2000, 1, 15), 5, 10), (2, 1, date(2000, 3, 1), 5, 20), (3, 1, date(2000, 4, 2), 1, 30)], "contig_id long, project_id long, created date, nreads int, length long")
    edges = spark.createDataFrame([(2, 1)], "contig_id long, parent_id long")
    got = [(r["day"].month, r["contig_id"]) for r in statistics.lived(contigs, edges).orderBy("day").collect()]
    assert got == [(2, 1), (4, 2)]
    placed = spark.createDataFrame([(1, 7), (2, 7), (1, 8)], "contig_id long, seq_id long")
    history = statistics.organism_history(contigs, edges, placed, spark.createDataFrame([(7, None), (8, date(2000, 1, 1))], "read_id long, asped date"), "month")
    assert [(r["day"].month, r["in_contigs"], r["free_reads"]) for r in history.orderBy("day").collect()] == [(2, 2, 0), (4, 1, 1)]
    assert statistics.project_history(contigs.limit(0), edges).count() == statistics.read_batches(frame.limit(0), 5).count() == 0


def plain_chains(items, bridges, least):
    best = {}
    for one_, side, other, end, n, gap in bridges:
        best.setdefault((one_, side), []).append((-n, other, end, gap))
    used, out = set(), []
    for seed, _ in sorted(items, key=lambda i: (i[1], i[0])):
        if seed in used:
            continue
        used.add(seed)
        chain = [(seed, "F", None)]
        for way in "RL":
            at, side = seed, way
            while step := min((b for b in best.get((at, side), []) if b[1] not in used and -b[0] >= least), default=None):
                _, other, end, gap = step
                used.add(other)
                turn = "F" if (way == "R") == (end == "L") else "R"
                if way == "R":
                    chain.append((other, turn, gap))
                else:
                    chain = [(other, turn, None), (chain[0][0], chain[0][1], gap), *chain[1:]]
                at, side = other, "R" if end == "L" else "L"
        out += [(seed, k, i, d, g) for k, (i, d, g) in enumerate(chain, 1)]
    return sorted(out, key=str)


def test_scaffold_chains(spark):
    rng = random.Random(9)
    items = [(i, -rng.randint(1, 9)) for i in range(40)]
    links = {}
    for _ in range(90):
        a, b, s, t = rng.randrange(40), rng.randrange(40), rng.choice("LR"), rng.choice("LR")
        if a != b:
            links[a, s, b, t] = links[b, t, a, s] = (rng.randint(1, 4), rng.randint(1, 50))
    bridges = [(*k, *v) for k, v in links.items()]
    frame = spark.createDataFrame(bridges, "one long, side string, other long, other_side string, n long, gap long")
    made = scaffolds.chained(spark.createDataFrame(items, "item long, rank long"), frame, 2)
    assert rows(made) == plain_chains(items, bridges, 2)
    assert rows(scaffolds.chained(spark.createDataFrame(items, "item long, rank long"), frame.limit(0), 2)) == sorted(((i, 1, i, "F", None) for i, _ in items), key=str)
    chains = spark.createDataFrame([(5, 1, 7, "R", None), (5, 2, 5, "F", 10)], scaffolds.CHAIN).withColumnRenamed("item", "contig_id")
    laid = scaffolds.layout(chains, spark.createDataFrame([(5, 100), (7, 40)], "contig_id long, length long"))
    assert [(r["contig_id"], r["start"], r["finish"], r["size"], r["gaps"]) for r in laid.orderBy("ordinal").collect()] == [(7, 1, 40, 150, 10), (5, 51, 150, 150, 10)]
    assert [r["line"].split("\t")[1:5] for r in scaffolds.agp(laid).orderBy("part").collect()] == [["1", "40", "1", "W"], ["41", "50", "2", "N"], ["51", "150", "3", "W"]]
    dna = spark.createDataFrame([(5, "AC"), (7, "GGT")], "contig_id long, dna string")
    assert rows(scaffolds.sequences(laid, dna)) == [(5, "ACC" + "N" * 10 + "AC")]
    assert scaffolds.tree(spark.createDataFrame([(5, 1, 5, "F")], "superscaffold long, ordinal long, scaffold long, direction string"), laid).first()["document"].count("contig_id") == 2
    place = "contig_id long, contig_length long, seq_id long, template_id long, strand string, direction string, cstart long, cfinish long, sihigh long"
    placed = spark.createDataFrame([(1, 100, 1, 1, "Forward", "Forward", 90, 99, 60), (2, 80, 2, 1, "Reverse", "Reverse", 5, 20, 60), (1, 100, 3, 2, "Forward", "Reverse", 50, 60, 30)], place)
    assert rows(scaffolds.links(placed)) == [(1, "R", 2, "L", 1, 30), (2, "L", 1, "R", 1, 30)]
    lists = spark.createDataFrame([("a", "12+, 7-,x,9")], "name string, value string")
    assert rows(scaffolds.ordered(lists)) == [("a", 1, 12, "F"), ("a", 2, 7, "R"), ("a", 4, 9, "F")]


def test_superscaffolds(spark):
    laid = spark.createDataFrame([(1, 1, 1, "F", None, 100, 1, 100, 100, 0, 1), (2, 1, 2, "R", None, 90, 1, 90, 90, 0, 1), (3, 1, 3, "F", None, 80, 1, 80, 80, 0, 1)],
                                 "scaffold long, ordinal long, contig_id long, direction string, gap_before long, length long, start long, finish long, size long, gaps long, contigs long")
    place = "contig_id long, contig_length long, seq_id long, template_id long, strand string, direction string, cstart long, cfinish long, sihigh long"
    each = [(t, 1, "Forward", "Forward", 95) for t in (1, 2)] + [(t, 2, "Reverse", "Forward", 85) for t in (1, 2)]
    placed = spark.createDataFrame([(c, 0, 10 * t + c, t, s, d, a, a + 4, 50) for t, c, s, d, a in each], place)
    # contig 2 is turned, so its forward read looks out of the left end of its scaffold
    assert rows(scaffolds.superscaffolds(laid, placed, 40)) == [(1, 1, 1, "F"), (1, 2, 2, "F"), (3, 1, 3, "F")]


def test_tags(spark):
    tag = "tag_id long, contig_id long, tagtype string, cstart long, cfinal long, strand string"
    links = spark.createDataFrame([(9, 1, 1, 100, 101, 150), (9, 1, 1, 110, 170, 200), (8, 1, -1, 60, 10, 59)], "contig_id long, parent_id long, dir int, shift long, cstart long, cfinish long")
    some = spark.createDataFrame([(1, 1, "CDS", 40, 70, "F"), (2, 1, "FIN", 40, 70, "C"), (3, 1, "FIN", 5, 9, "F")], tag)
    got = {(r["tag_id"], r["contig_id"]): (r["cstart"], r["cfinal"], r["strand"], r["frame_shifts"], r["left_cut"], r["right_cut"]) for r in tags.remapped(some, links).collect()}
    assert got[1, 9] == (140, 180, "F", 1, False, False) and got[2, 8] == (10, 20, "F", 0, False, True) and got[3, 8] == (51, 55, "C", 0, False, False)
    kinds = {(r["tag_id"], r["contig_id"]): r["tagtype"] for r in tags.propagated(some, links, 1).collect()}
    assert kinds == {(1, 9): "CDS", (2, 9): "ASIT", (3, 9): "FIN", (1, 8): "CDS", (2, 8): "ASIT", (3, 8): "FIN"}
    dna = spark.createDataFrame([(1, "ACGTACGTAC")], "contig_id long, dna string")
    parts = tags.split(tags.composite(spark.createDataFrame([(1, 1, "T", 1, 2, "F"), (2, 1, "T", 5, 6, "F")], tag)), dna)
    assert rows(tags.collapsed(parts)) == [(1, "T", 1, 6, 2, "ACXXAC")]
    merged = tags.merged(spark.createDataFrame([(1, 1, "T", 1, 5, None), (2, 1, "T", 6, 9, None), (3, 1, "T", 11, 12, None)], tag).withColumn("sysid", F.lit("s")))
    assert rows(merged.select("cstart", "cfinal", "tags")) == [(1, 9, 2), (11, 12, 1)]
    assert rows(tags.lineage(spark.createDataFrame([(3, 2), (2, 1), (1, None)], "tag_id long, parent_tag_id long"))) == [(1, 2, -1), (1, 3, -2), (2, 1, 1), (2, 3, -1), (3, 1, 2), (3, 2, 1)]
    assert tags.remapped(some.limit(0), links).count() == tags.merged(some.limit(0).withColumn("sysid", F.lit("s"))).count() == 0
    repeats = spark.createDataFrame([("r1", 3, 9, True, "Alu"), ("r2", 1, 2, False, "new")], "one string, one_first long, one_last long, turned boolean, two string")
    made = tags.repeat_tags(repeats, spark.createDataFrame([("r1", 10)], "readname string, qleft long"), spark.createDataFrame([("Alu", "Alu family")], "name string, title string"))
    assert rows(made) == [("r1", "REPT", 13, 19, "R", "Alu family"), ("r2", "REPT", 1, 2, "F", "new")]
    book = tags.dictionary(spark.createDataFrame([("o1", "ACGT"), ("o2", "ACGT"), ("o3", None)], "sysid string, oligo string"), spark.createDataFrame([("x", "TTTT")], "name string, oligo string"))
    assert rows(book) == [("o1", "ACGT", True)]


def test_every_rule_finds_its_fault(spark):
    make = spark.createDataFrame
    t = {
        "contig": make([(1, 2), (2, 0), (3, 1)], "contig_id long, nreads int"), "mapping": make([(1, 10), (4, 10), (3, 99)], "contig_id long, seq_id long"), "reads": make([(1, 5), (2, 6)], "read_id long, template_id long"),
        "versions": make([(10, 1, 0), (11, 8, 0)], "seq_id long, read_id long, version int"), "clip": make([(10,)], "seq_id long"), "sequences": make([(10,), (12,)], "seq_id long"),
        "template": make([(5, 7), (9, 3)], "template_id long, ligation_id long"), "ligation": make([(7, 4), (8, None)], "ligation_id long, clone_id long"), "clone": make([(1,)], "clone_id long"),
    }
    got = {}
    for r in integrity.check(t).collect():
        got.setdefault(r["rule"], []).append(r["message"])
    assert got == {
        "mapping_count": ["contig 1 has 2 reads but 1 mappings"], "orphan_contigs": ["contig 2 has no reads"], "mapping_contig": ["sequence 10 is mapped to contig 4, which does not exist"],
        "mapping_read": ["sequence 99 in contig 3 has no read"], "clip": ["sequence 11 has no quality clip"], "seq2read": ["sequence 12 belongs to no read"], "seq_read": ["sequence 11 belongs to read 8, which does not exist"],
        "template": ["read 2 has no template 6"], "ligation": ["template 9 has no ligation 3"], "clone": ["ligation 7 has no clone 4"],
    }
    whole = make([(1, "AC", [1]), (2, "", []), (3, "A", None)], "seq_id long, dna string, quality array<int>")
    assert rows(integrity.without_sequence(make([(1,), (2,), (3,), (4,)], "read_id long"), make([(1, 1, 0), (2, 2, 0), (3, 3, 0)], "seq_id long, read_id long, version int"), whole)) == [(2, "empty sequence"), (3, "no quality"), (4, "no sequence")]
    assert integrity.check({k: v.limit(0) for k, v in t.items()}).count() == 0


def test_kmers_and_oligos(spark):
    rng = random.Random(1)
    base = "".join(rng.choice("ACGT") for _ in range(120))
    turned = base[30:90][::-1].translate(str.maketrans("ACGT", "TGCA"))
    some = spark.createDataFrame([(1, base), (2, base[20:]), (3, turned), (4, base), (5, None), (6, "ACNNN" * 8)], "seq_id long, dna string")
    reps, member = kmers.representatives(some.where("dna is not null"))
    assert rows(member) == [(1, 1), (2, 2), (3, 3), (4, 1), (6, 6)]
    found = kmers.index(reps, 11)
    assert {tuple(r) for r in kmers.offsets(found, 20).collect()} == {(1, 2, 1, 20, 90), (1, 3, -1, 91, 50), (2, 3, -1, 71, 50)}
    assert {tuple(r) for r in kmers.alignment_segments(found, 11, some, least=20).collect()} == {(1, 2, 1, 20, 21, 120), (1, 3, -1, 91, 31, 90), (2, 3, -1, 71, 11, 70)}
    best = alignment.oriented(kmers.best_offsets(kmers.offsets(found)), some, sequences.reverse_complement)
    for band in (0, 3, None):
        scores = {tuple(r) for r in alignment.aligned(best, band).select("seq_a", "seq_b", "dir", "shift", "n", "score").collect()}
        assert scores == {(1, 2, 1, 20, 90, 100), (1, 3, -1, 91, 50, 60), (2, 3, -1, 71, 50, 60)}
    counts = {r["seq_id"]: (r["accepted"], r["rejected"]) for r in kmers.accepted(some, 11).collect()}
    assert counts[1] == (110, 0) and counts[6] == (0, 30)
    packed = kmers.packed(spark.createDataFrame([(1, "ACGTT")], "seq_id long, dna string"), 2)
    assert rows(packed) == sorted([(1, 1, 1), (6, 1, 2), (11, 1, 3), (15, 1, 4)], key=str)
    with pytest.raises(ValueError):
        kmers.index(some, 10)
    padded = spark.createDataFrame([(1, "ttAC-GTaa"), (2, "AAAA")], "seq_id long, dna string")
    hits = kmers.oligo_hits(padded, {"p": "acgt", "a": "AA"})
    assert rows(hits) == [("a", "F", 1, 7), ("a", "F", 2, 0), ("a", "F", 2, 2), ("a", "R", 1, 0), ("p", "F", 1, 2)]


def test_reads(spark):
    given = spark.createDataFrame([(1, None, "c", 1, 1, "AC", [1, 2], "PASS"), (2, date(2000, 1, 1), None, None, 1, None, None, "FAIL"), (3, date(2000, 1, 1), "c", 1, 1, "AC", [1], "PASS"), (4, date(2000, 1, 1), "c", 1, 1, "A", [1], "PASS")],
                                  "read_id long, asped date, chemistry string, ligation_id long, qleft int, dna string, quality array<int>, status string")
    assert rows(reads.incomplete(given)) == [(1, "no date"), (2, "no chemistry, no ligation, no sequence, no pass"), (3, "lengths differ")]
    assert rows(reads.incomplete(given, skip=("no date", "no pass"))) == [(2, "no chemistry, no ligation, no sequence"), (3, "lengths differ")]
    free = spark.createDataFrame([(1, "ACGTACGT", list(range(8))), (2, None, None), (3, "AC", [1, 1]), (4, "ACGT", [1] * 4), (5, "AC", [1, 1])], "read_id long, dna string, quality array<int>")
    screened = spark.createDataFrame([(1, 2, 7), (3, 1, 2), (5, 0, 3)], "seq_id long, qleft int, qright int")
    made = reads.single_read_contigs(free, spark.createDataFrame([(5,)], "seq_id long"), screened)
    assert rows(made["status"]) == [(1, "ok"), (2, "no sequence"), (3, "too short"), (4, "no clip")]
    assert rows(made["consensus"]) == [(1, "GTAC", [2, 3, 4, 5])] and rows(made["segment"]) == [(1, 1, 1, 3, 4)]
    fasta = spark.createDataFrame([("a.1", "ACG"), ("a.2", "A"), ("b", ""), ("old", "C"), ("a.1", "ACG")], "name string, dna string")
    made = reads.imported_consensus(fasta, spark.createDataFrame([("old",)], "readname string"), spark.createDataFrame([("t", 40)], "name string, template_id long"))
    assert made["reads"].count() == 3 and sorted(r["template_id"] for r in made["template"].collect()) == [41, 42]
    matched = reads.versions_matched(spark.createDataFrame([("r", "h1", "q"), ("r", "h9", "q"), ("n", "x", "y")], "readname string, seq_hash string, qual_hash string"),
                                     spark.createDataFrame([("r", 0, "h0", "q"), ("r", 1, "h1", "q")], "readname string, version int, seq_hash string, qual_hash string"))
    assert rows(matched) == [("n", 0, True), ("r", 1, False), ("r", 2, True)]
    out = reads.processed(spark.createDataFrame([(1, 5), (1, 6), (2, 1)], "contig_id long, x long"), lambda g: pd.DataFrame({"contig_id": [g["contig_id"].iloc[0]], "s": [g["x"].sum()]}), "contig_id long, s long")
    assert rows(out) == [(1, 11), (2, 1)]
    lows = reads.low_quality_reads(spark.createDataFrame([(1, 1, 1, 10, 1, 10, 1), (1, 2, 8, 20, 1, 13, 1)], SEG), spark.createDataFrame([(1, 9), (1, 15)], "contig_id long, pos long"))
    assert rows(lows) == [(1, 1, 1, 1), (1, 2, 2, 1)]


def test_selections_and_joins(spark):
    names = spark.createDataFrame([(1, "a.p1k", "PASS", date(2000, 1, 1)), (2, "a.q1k", "FAIL", None), (3, "b_p1k", "PASS", date(2001, 1, 1)), (4, None, "PASS", None)], "read_id long, readname string, status string, asped date")
    placed = spark.createDataFrame([(2, 7)], "seq_id long, contig_id long")
    found = lambda *a, **k: [r[0] for r in rows(selections.find_reads(names, placed, *a, **k))]
    assert found("a*") == [1, 2] and found("a*", only_free=True) == [1] and found("b_p1k") == [3] and found("zz") == []
    pick = lambda **k: [r[0] for r in rows(selections.select_reads(names, **k))]
    assert pick() == [1, 3, 4] and pick(after="2000-06-01") == [3] and pick(status=None, matching="q") == [2] and pick(limit=1, like="%k") == [1] and pick(before="2000-06-01", unlike="b%") == [1]
    mangled = spark.createDataFrame([(1, "t1.p1k"), (2, "t1.q2k.x-1"), (3, "t1.p3k.x"), (4, "t1.p1k."), (5, None), (6, "a.q1k._b.c")], "read_id long, readname string")
    assert [r[0] for r in rows(selections.invalid_names(mangled))] == [2, 6] and [r[0] for r in rows(selections.valid_names(mangled))] == [1, 3, 4, 5]
    asked = spark.createDataFrame([(1, 1, 7, "pending"), (2, 1, 7, "pending"), (3, 2, 7, "done"), (4, 2, 7, "pending"), (5, 3, 8, "pending"), (6, 9, 7, "pending"), (7, 4, 7, "approved"), (8, 4, 7, "pending")],
                                  "request_id long, contig_id long, old_project_id long, status string")
    now = spark.createDataFrame([(1, 7), (2, 7), (3, 7), (4, 7)], "contig_id long, project_id long")
    assert rows(selections.transfer_candidates(asked, now)) == [(1, "active"), (2, "already requested"), (4, "active"), (5, "project changed"), (6, "not current"), (8, "already requested")]
    contigs = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "contig_id long, length long")
    edges = spark.createDataFrame([(2, 1)], "contig_id long, parent_id long")
    by = lambda **k: [r[0] for r in rows(selections.contigs_by_property(contigs, edges, **k))]
    assert by() == [1, 3] and by(scope="current", length=(15, None)) == [2, 3] and by(scope="all", length=(None, 20)) == [1, 2]
    place = spark.createDataFrame([(1, 5, "Forward", 3), (2, 5, "Forward", 3), (3, 5, "Reverse", 9)], "read_id long, template_id long, strand string, project_id long")
    want = spark.createDataFrame([(10, 5, "Reverse"), (11, 5, "Unknown"), (12, 6, "Forward")], "read_id long, template_id long, strand string")
    assert rows(joins.votes(want, place)) == [(10, 9, 1, True), (11, 3, 2, False)]
    m = spark.createDataFrame([(1, 1, 1, 100), (1, 2, 50, 140), (1, 3, 60, 90), (1, 4, 2000, 2100)], "contig_id long, seq_id long, cstart long, cfinish long")
    assert rows(joins.best_overlaps(m).select("seq_id", "other", "overlap", "kind")) == [(1, 2, 51, "R"), (2, 1, 51, "L"), (3, 1, 31, "C")]


def test_increment(spark, tmp_path):
    schema = "read_id long, readname string"
    stored = spark.createDataFrame([(5, "a"), (3, "b")], schema)
    new = spark.createDataFrame([(4, "x"), (6, "a"), (7, "c"), (7, "c"), (8, None)], schema)
    assert [r[0] for r in rows(increment(new, stored))] == [7, 8] and increment(new.where("read_id < 8"), stored.limit(0)).count() == 3
    source, target, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    stored.write.parquet(source)
    follow(spark, source, schema, target, mark).awaitTermination()
    spark.createDataFrame([(6, "a"), (7, "c")], schema).write.mode("append").parquet(source)
    follow(spark, source, schema, target, mark).awaitTermination()
    assert rows(spark.read.parquet(target).select("readname")) == [("a",), ("b",), ("c",)]


def test_store_and_relational_reads(spark, tmp_path):
    tables.write(spark.createDataFrame([(1, 5)], "contig_id long, nreads long"), str(tmp_path), "contig")
    got = tables.read(spark, str(tmp_path), "contig").first()
    assert (got["contig_id"], got["nreads"], got["origin"]) == (1, 5, None)
    with pytest.raises(ValueError):
        tables.write(spark.createDataFrame([(1,)], "nothing long"), str(tmp_path), "contig")
    url = f"jdbc:derby:{tmp_path}/store;create=true"
    driver = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    given = spark.createDataFrame([(k, f"r{k}") for k in range(20)], "read_id long, readname string")
    given.write.format("jdbc").option("url", url).option("dbtable", "reads").options(**driver).option("createTableColumnTypes", "readname varchar(20)").save()
    found = files.read_jdbc_reads(spark, url, "reads", given.where("read_id % 3 > 0"), parts=3, key='"read_id"', **driver)
    assert sorted(r["readname"] for r in found.select("readname").collect()) == ["r0", "r12", "r15", "r18", "r3", "r6", "r9"]


def test_caf_comes_back(spark, tmp_path):
    contigs = spark.createDataFrame([("c1", "ACGT" * 20, [1] * 80), ("c2", None, None)], "name string, dna string, quality array<int>")
    segments = spark.createDataFrame([("c1", "r1", 1, 5, 5, 1)], "name string, read string, cstart long, cfinish long, rstart long, rfinish long")
    some = spark.createDataFrame([("r1", "t1", "Forward", 500, 900, 2, None, "ACG", [1, 2, 3])], "name string, template string, strand string, si_low long, si_high long, qleft long, qright long, dna string, quality array<int>")
    exchange.caf(contigs, segments, some).write.option("lineSep", "\n\n").text(str(tmp_path / "caf"))
    blocks = files.caf_blocks(spark, str(tmp_path / "caf"))
    assert rows(files.caf_segments(blocks)) == [("c1", "r1", 1, 5, 5, 1)]
    assert rows(files.caf_reads(blocks)) == [("r1", "t1", "Forward", 500, 900, None)]
    assert {r["name"]: len(r["quality"]) for r in files.caf_sequences(blocks).collect()} == {"c1": 80, "r1": 3}
    (tmp_path / "v").write_text('Sequence : r1\nIs_read\nSeq_vec SVEC 1 20 "puc19"\nClone_vec CVEC 90 120\n')
    assert rows(files.caf_vectors(files.caf_blocks(spark, str(tmp_path / "v")))) == [("r1", "Clone_vec", 90, 120, ""), ("r1", "Seq_vec", 1, 20, "puc19")]


PADDED = [(1, "ac-gt  nA*c"), (2, ""), (3, None), (4, " -*"), (5, "a"), (6, "zq"), (7, "-acgtacgtnnacgtxé𝒳-acgttttgcatgcaacg*")]


def test_whole_sequences_are_read_where_they_lie(spark):
    def quality(codes):
        return codes * 7 % 41

    whole = spark.createDataFrame(PADDED, "seq_id long, dna string")
    bases = spark.createDataFrame([(i, k + 1, c, ord(c) * 7 % 41) for i, t in PADDED for k, c in enumerate(t or "")], "seq_id long, pos long, base string, q int")
    for args in ((15, 15, 0), (2, 30, 12)):
        assert rows(sequences.low_places(whole, quality, *args)) == rows(sequences.low_quality(bases, *args))
        want = sequences.with_low_replaced(bases, sequences.low_quality(bases, *args), "?")
        assert rows(sequences.low_replaced(whole, quality, "?", *args)) == rows(want)
    assert rows(sequences.clips_of(whole, quality)) == rows(sequences.quality_clips(bases))
    spelled, segments = sequences.without_positions(bases, bases.where("base in (' ', '-', '*')"))
    found = sequences.unpadded(whole)
    assert rows(found.select("seq_id", "dna", "kept")) == rows(spelled.select("seq_id", "dna", F.size("quality").alias("kept")))
    assert rows(found.selectExpr("seq_id", "inline(segments)")) == rows(segments.select("seq_id", "x0", "x1", "y0", "y1"))


def test_letters_and_sites_are_not_shuffled(spark):
    whole = spark.createDataFrame([(1, "GAATTCGANTCGAATTC")], "seq_id long, dna string")
    for df in (sequences.low_places(whole, lambda c: c % 41), sequences.low_replaced(whole, lambda c: c % 41, "n"), sequences.unpadded(whole), sequences.clips_of(whole, lambda c: c % 41),
               sequences.digest(whole, {"EcoRI": "GAATTC"}), kmers.oligo_hits(whole, {"three": "GAATTC", "one": "ACGTACG"})):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Union" not in plan
