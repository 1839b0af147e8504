"""Gapped alignment against a plain full matrix; k-mer hits in blocks and bands; segments on hand-made pairs."""

import random

import pytest
from pyspark.sql import functions as F

from strandlake.functions import alignment, kmers

ROWS = "seq_a long, seq_b long, dir int, shift long, first_base long, last_base long"


def plain(a, b, move, band):
    """Score, best cell and runs of equal letters by the whole matrix."""
    scores, ways, best = {}, {}, (0, None)
    at = lambda r, c: scores.get((r, c), 0)
    for r, x in enumerate(a.upper()):
        for c, y in enumerate(b.upper()):
            if band is not None and abs(r - move - c) > band:
                continue
            pair = 0 if "N" in (x, y) else 1 if x == y != "X" else -2
            diagonal, up, left = at(r - 1, c - 1) + pair, at(r - 1, c) - 4, at(r, c - 1) - 4
            scores[r, c] = max(diagonal, up, left, 0)
            ways[r, c] = (1, 1) if diagonal >= max(up, left) else (1, 0) if up > left else (0, 1)
            if scores[r, c] > best[0]:
                best = scores[r, c], (r, c)
    runs, run, cell = [], None, best[1]
    while cell and at(*cell) > 0:
        r, c = cell
        if a[r].upper() != b[c].upper():
            run = None
        elif run and (run[0], run[2]) == (r + 2, c + 2):
            run[0], run[2] = r + 1, c + 1
        else:
            run = [r + 1, r + 1, c + 1, c + 1]
            runs.append(run)
        cell = (r - ways[cell][0], c - ways[cell][1])
    return best[0], *((best[1][0] + 1, best[1][1] + 1) if best[1] else (None, None)), [tuple(x) for x in reversed(runs)]


@pytest.mark.parametrize("band", [None, 0, 2, 7])
def test_alignment_is_that_of_the_whole_matrix(spark, band, monkeypatch):
    rng, pairs = random.Random(band), []
    for _ in range(80):
        a = "".join(rng.choice("ACGTNXacgt") for _ in range(rng.randint(0, 50)))
        b = list(a[rng.randint(0, 5) :]) if rng.random() < 0.7 else [rng.choice("ACGT") for _ in range(rng.randint(0, 50))]
        for _ in range(rng.randint(0, 4) if b else 0):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randint(0, 2)] = rng.choice(["", "A", "GT"])
        pairs.append((len(pairs), a, "".join(b), rng.randint(-6, 6)))
    pairs += [(len(pairs), None, "ACGT", 0), (len(pairs) + 1, "", "", 0), (len(pairs) + 2, "ACGT", "ACGT", 100), (len(pairs) + 3, "é", "é", 0)]
    frame = spark.createDataFrame(pairs, "id long, a string, b string, move long").repartition(2)
    for cells, every in ((1 << 16, 512), (60, 3)):
        alignment.CELLS, alignment.EVERY, before = cells, every, (alignment.CELLS, alignment.EVERY)
        found = alignment.aligned(frame, band, segments=True).collect()
        alignment.CELLS, alignment.EVERY = before
        assert len(found) == len(pairs)
        for r in found:
            _, a, b, move = pairs[r["id"]]
            assert (r["score"], r["a_end"], r["b_end"], [tuple(x) for x in r["runs"]]) == plain(a or "", b or "", move, band), pairs[r["id"]]


def test_long_pairs_keep_few_rows():
    rng = random.Random(5)
    a = "".join(rng.choice("ACGT") for _ in range(20_000))
    b = a[:5000] + "G" + a[5000:12_000] + a[12_003:]
    matrix = alignment.Matrix([alignment.codes(a)], [alignment.codes(b)], [0], 20)
    score, row, column, kept = matrix.best()
    assert score[0] == 20_000 - 3 - 4 - 12 and len(kept) == -(-20_000 // alignment.EVERY)
    runs = matrix.runs(0, int(row[0]), int(column[0]), kept)
    assert sum(r[1] - r[0] + 1 for r in runs) == 19_997 and runs[-1][1::2] == (20_000, 19_998)


def plain_hits(places, k, band=None, shifts=None):
    out = []
    turned = lambda w: w[::-1].translate(str.maketrans("ACGT", "TGCA"))
    for a, p, x in places:
        for b, q, y in places:
            for way, same, shift in ((1, x == y, p - q), (-1, x == turned(y), p + q)):
                near = not band or (abs(q - p * band[0] - band[1]) <= band[2] and (band[0] > 0) == (way > 0))
                if a < b and same and near and (not shifts or shifts[0] <= shift <= shifts[1]):
                    out.append((a, b, way, shift, p))
    return sorted(out)


def test_hits_in_blocks_and_bands(spark):
    rng = random.Random(6)
    dna = ["ACACACAC" * 4, "GTGTGTGT" * 3 + "TT", "".join(rng.choice("ACGT") for _ in range(60)), "ACACA" * 5]
    dna.append(dna[2][10:] + dna[0])
    index = kmers.index(spark.createDataFrame(list(enumerate(dna)), "seq_id long, dna string"), 5)
    places = [tuple(r) for r in index.collect()]
    found = lambda **how: sorted(tuple(r) for r in kmers.hits(index, **how).collect())
    want = plain_hits(places, 5)
    assert found() == found(block=3) == found(block=7) == want and len(want) > 500
    for band in ((1.0, 4.0, 3.0), (-1.0, 40.0, 6.0)):
        assert found(band=band) == found(band=band, block=3) == plain_hits(places, 5, band=band) != []
    assert found(shifts=(-3, 12), block=4) == plain_hits(places, 5, shifts=(-3, 12)) != []


def test_a_frequent_kmer_spreads(spark):
    index = spark.range(6000).selectExpr("id % 3000 as seq_id", "id as centre", "'ACGTC' as kmer")
    blocks = spark.createDataFrame([("ACGTC", 6, 6)], "kmer string, m int, n int")
    a = kmers.dealt(index.withColumnRenamed("seq_id", "seq_a"), blocks, "seq_a", "centre", "m", "n", ("i", "j")).groupBy("i", "j").count().collect()
    assert len(a) == 36 and max(r["count"] for r in a) < 1300 and sum(r["count"] for r in a) == 36_000


def test_embedded_segments_go(spark):
    made = lambda rows: spark.createDataFrame([(1, 2, *r) for r in rows], ROWS)
    got = lambda df: sorted(tuple(r)[2:] for r in df.collect())
    inside_a, inside_b, big = (1, 3, 20, 30), (1, -60, 1, 10), (1, 0, 10, 80)
    assert got(kmers.outermost(made([big, inside_a, inside_b]))) == [big]
    repeats = [(1, 0, 10, 40), (1, -100, 10, 40), (1, 5, 90, 120)]
    assert got(kmers.outermost(made(repeats))) == [repeats[2]]
    turned = [(-1, 100, 10, 60), (-1, 140, 80, 90)]  # b 90..40 and 60..50
    assert got(kmers.outermost(made(turned))) == [turned[0]]
    assert got(kmers.outermost(made([(1, 0, 10, 20), (1, 0, 15, 30)]))) == [(1, 0, 10, 20), (1, 0, 15, 30)]


def test_overlaps_are_shared_out(spark):
    made = lambda rows: spark.createDataFrame([(1, 2, *r) for r in rows], ROWS)
    got = lambda rows: sorted(tuple(r)[2:] for r in kmers.parted(made(rows)).collect())
    assert got([(1, 0, 1, 50), (1, 3, 48, 90)]) == [(1, 0, 1, 47), (1, 3, 51, 90)]  # 3 in a, 6 in b: 3 each
    assert got([(1, 0, 1, 50), (1, -3, 48, 90)]) == [(1, -3, 50, 90), (1, 0, 1, 48)]  # 3 in a, none in b: 2 each
    assert got([(-1, 100, 1, 50), (-1, 103, 51, 90)]) == [(-1, 100, 1, 48), (-1, 103, 53, 90)]  # b 99..50 and 52..13: 3 shared
    assert got([(1, 0, 1, 50), (1, 0, 60, 90)]) == [(1, 0, 1, 50), (1, 0, 60, 90)]


def test_discordant_segments_go(spark):
    rows = [(1, 2, 1, s, 100 * i, 100 * i + 50) for i, s in enumerate([0, 1, 1, 40, 2, -9, -12, 3, 12, 12, 12, 13, 14])]
    found = {r["first_base"] for r in kmers.concordant(spark.createDataFrame(rows, ROWS)).collect()}
    want = set()
    for i, r in enumerate(rows):
        near = sorted(x[3] for x in rows[max(0, i - 5) : i + 6])
        if abs(near[len(near) // 2] - r[3]) <= 10:
            want.add(r[4])
    assert found == want and 300 not in found and len(found) > 8


def test_unread_letters_do_not_part_segments(spark):
    base = "ACGTTGCAAT" * 6
    b = base[:20] + "N" + base[21:40] + "T" + base[41:]
    turn = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    dna = spark.createDataFrame([(1, base), (2, b), (3, turn(b))], "seq_id long, dna string")
    rows = [(1, 2, 1, 0, 1, 20), (1, 2, 1, 0, 22, 40), (1, 2, 1, 0, 42, 60), (1, 3, -1, 61, 1, 20), (1, 3, -1, 61, 22, 40), (1, 3, -1, 61, 42, 60)]
    found = sorted(tuple(r) for r in kmers.joined(spark.createDataFrame(rows, ROWS), dna).collect())
    assert base[40] != "T" and found == [(1, 2, 1, 0, 1, 40), (1, 2, 1, 0, 42, 60), (1, 3, -1, 61, 1, 40), (1, 3, -1, 61, 42, 60)]


def test_segments_of_pairs_with_gaps(spark):
    rng = random.Random(9)
    base = "".join(rng.choice("ACGT") for _ in range(300))
    gapped = base[:100] + base[102:200] + "N" + base[201:]
    dna = spark.createDataFrame([(1, base), (2, gapped)], "seq_id long, dna string")
    found = [tuple(r)[3:] for r in kmers.alignment_segments(kmers.index(dna, 11), 11, dna, least=20).orderBy("first_base").collect()]
    assert [f[0] for f in found] == [0, 2] and found[1][2] == 300 and 96 <= found[0][2] <= 101 and found[1][1] <= 106


def test_ends_of_runs_stand_for_all_hits(spark):
    rng = random.Random(6)
    dna = ["ACACACAC" * 4, "GTGTGTGT" * 3 + "TT", "".join(rng.choice("ACGT") for _ in range(60)), "ACACA" * 5 + "NACACAC", "A" * 40]
    dna += [dna[2][10:] + dna[0], "T" * 30, ""]
    some = spark.createDataFrame(list(enumerate(dna)), "seq_id long, dna string")
    strings, numbers = kmers.index(some, 5), kmers.places(some, 5)
    want = {}
    for a, b, way, shift, _ in plain_hits([tuple(r) for r in strings.collect()], 5):
        want[a, b, way, shift] = want.get((a, b, way, shift), 0) + 1
    for index in (strings, numbers):
        assert {tuple(r)[:4]: r["n"] for r in kmers.offsets(index).collect()} == want
    for few, block in ((0, 4096), (0, 5), (3, 7)):
        ends = kmers.breaks(numbers, few, block)
        assert {tuple(r)[:4]: r["n"] for r in ends.groupBy(*kmers.PAIR, "shift").agg(F.expr("sum(if(last, centre + 1, -centre)) as n")).collect()} == want
    copies = spark.createDataFrame([(i, dna[2]) for i in range(2)], "seq_id long, dna string")
    assert kmers.breaks(kmers.places(copies, 5)).where("dir = 1 and shift = 0").count() == 2  # of 56 hits


def test_windows_of_pieces(spark, monkeypatch):
    rng = random.Random(7)
    texts = ["".join(rng.choice("ACGTN" if n % 3 else "ACGT") for _ in range(n)) for n in (3, 11, 12, 50, 200, 131)] + ["N" * 20, "", "a\u00e9cgtacgtacgtaccgt"]
    some = spark.createDataFrame([*enumerate(texts), (99, None)], "seq_id long, dna string")
    plain = {}
    for i, text in enumerate(texts):
        for at in range(len(text) - 10):
            plain.setdefault(i, []).append((text[at : at + 11].upper(), at + 6))
    good = {i: [w for w in found if not set(w[0]) - set("ACGT")] for i, found in plain.items()}
    want = sorted((i, len(g), min(g)[0], max(at for _, at in g), len(plain[i]) - len(g)) for i, g in good.items() if g)
    number = lambda word: sum("ACGT".index(c) << 2 * p for p, c in enumerate(reversed(word)))
    ends = sorted((number(w), i, at - 5) for i, g in good.items() for w, at in g if at + 5 <= 30 or at - 5 > len(texts[i]) - 30)
    for piece in (kmers.PIECE, 13):
        monkeypatch.setattr(kmers, "PIECE", piece)
        held = [*kmers.read_pieces([(i, t.upper()) for i, t in enumerate(texts)], 11)]
        assert sorted((w.ids[k], int(p), int(c)) for w in (kmers.windows_of(h, 11) for h in held) for k, p, c in zip(w.which, w.pos, w.code)) == sorted((i, at - 5, number(w)) for i, g in good.items() for w, at in g)
    assert sorted(tuple(r) for r in kmers.summed(some, 11).collect()) == want
    assert [tuple(r) for r in kmers.packed(some, 11, 30).collect()] == ends
