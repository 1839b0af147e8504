"""Currency, placement, sweeps and activity against hand-computed values and plain Python, with nulls, ties and empty tables."""

import random
from datetime import date, datetime

from pyspark.sql import functions as F

from strandlake.functions import activity, intervals, mappings, placements, scaffolds

CONTIG = "contig_id long, project_id int, created date, nreads long, length int"
EDGE = "contig_id long, parent_id long"
MAP = "contig_id long, seq_id long, cstart int, cfinish int"
SEG = "contig_id long, seq_id long, x0 long, x1 long, y0 long, y1 long, dir int"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def contigs(spark):
    return spark.createDataFrame([(1, 0, date(2000, 1, 1), 2, 10), (2, 0, date(2000, 3, 1), 3, 20), (3, 1, date(2000, 5, 1), 1, 5), (4, None, None, 0, None)], CONTIG)


def test_currency(spark):
    edges = spark.createDataFrame([(2, 1), (3, 1), (None, None), (9, 3)], EDGE)
    ids = lambda df: [r[0] for r in rows(df.select("contig_id"))]
    assert ids(placements.current(contigs(spark), edges)) == [2]
    assert ids(placements.current(contigs(spark), edges, more_reads_than=-1)) == [2, 4]
    assert ids(placements.initial(contigs(spark), edges)) == [1, 4]
    as_of = lambda day, least: ids(placements.current_as_of(contigs(spark), edges, day, least))
    assert as_of("2000-02-01", 1) == [1]
    assert as_of("2000-04-01", 1) == [1, 2]  # the child 3 is younger
    assert as_of("2000-06-01", 0) == [2]  # both children are there; the child 9 of 3 is unknown, so 3 isn't current
    assert ids(placements.current(contigs(spark).limit(0), edges)) == []


def test_free_reads(spark):
    reads = spark.createDataFrame([(1, 7), (2, 7), (3, 8), (None, None)], "read_id long, template_id long")
    placed = spark.createDataFrame([(1, 1, 1, 5), (1, None, 1, 5)], MAP)
    assert rows(placements.free_reads(reads, placed).select("read_id")) == [(2,), (3,), (None,)]
    templates = spark.createDataFrame([(7, 70), (8, None)], "template_id long, ligation_id long")
    ligations = spark.createDataFrame([(70, 5)], "ligation_id long, clone_id int")
    assert rows(placements.free_by_origin(reads, placed, templates, ligations)) == [(5, 1)]
    assert placements.free_reads(reads, placed.limit(0)).count() == 4


def test_shared_reads(spark):
    found = spark.createDataFrame([(1, 5, 1, 9, 0), (2, 5, 3, 8, 0), (3, 5, 2, 7, 1), (1, 6, 1, 4, 0), (2, 6, 5, 8, 0), (1, None, 1, 1, 0), (2, None, 1, 1, 0)], MAP + ", project_id int")
    wanted = spark.createDataFrame([(2,)], "contig_id long")
    assert rows(placements.sharing_pairs(found)) == [(1, 2, 2), (1, 3, 1), (2, 3, 1)]
    assert rows(placements.sharing_pairs(found, wanted)) == [(2, 1, 2), (2, 3, 1)]
    assert rows(placements.allocation(found)) == [(5, 1, 2, "inside"), (5, 1, 3, "between"), (5, 2, 3, "between"), (6, 1, 2, "inside")]
    assert rows(placements.family(found, wanted)) == [(2, 1, "ancestor"), (2, 3, "descendant")]
    assert rows(placements.family(found, kind="ancestor")) == [(2, 1, "ancestor"), (3, 1, "ancestor"), (3, 2, "ancestor")]
    assert (1, 2, 6, 1, 4, 5, 8) in rows(placements.shared_segments(found))
    assert rows(placements.duplicates(found)) == [(5, 3), (6, 2)]
    assert rows(placements.in_several_contigs(found.unionByName(found))) == [(5, 3), (6, 2)]
    assert placements.duplicate_placements(found).count() == 5
    assert rows(placements.current_contig(found.where("seq_id = 5"))) == [(5, 3, 1)]
    edges = spark.createDataFrame([(3, 1)], EDGE)
    current = found.where("contig_id = 3")
    assert rows(placements.current_for_ancestors(current, found, edges)) == [(3, 1)]
    assert rows(placements.current_for_ancestors(current, found, edges, wanted)) == []
    assert placements.sharing_pairs(found.limit(0)).count() == 0


def test_spans_clips_and_ends(spark):
    placed = spark.createDataFrame([(1, 10, 7, "Forward", 1, 50, 100), (1, 11, 7, "Reverse", 90, 130, 100), (1, 12, 7, "Reverse", 90, 120, 100)],
                                   "contig_id long, seq_id long, template_id long, strand string, cstart int, cfinish int, sihigh int")
    assert rows(placements.template_spans(placed)) == [(1, 7, -69, "inconsistent"), (1, 7, 30, "consistent")]
    extents = spark.createDataFrame([(1, 3, 20), (2, 6, 30), (3, 1, 1)], "seq_id long, rmin int, rmax int")
    clips = spark.createDataFrame([(1, 5, 18), (2, 10, 30), (None, 1, 1)], "seq_id long, qleft int, qright int")
    assert rows(placements.clip_excess(extents, clips)) == [("left", 2, 4, 3.0, 1.0), ("right", 1, 2, 2.0, 0.0)]
    ends = placements.end_reads(spark.createDataFrame([(1, 5, 1, 9), (1, 4, 1, 10), (1, 3, 2, 10), (2, 8, 1, 10)], MAP), contigs(spark))
    assert rows(ends) == [(1, 4, 3), (2, 8, None)]


def test_sweeps_are_the_loops(spark):
    rng = random.Random(3)
    many = [(rng.randrange(3), k, s := rng.randrange(0, 6000), s + rng.randrange(0, 60)) for k in range(300)]
    many += [(7, 1000 + k, 5, 5) for k in range(3)] + [(8, 2000, 1, 5000), (8, 2001, 10, 20), (8, 2002, 4990, 4995), (8, 2003, 6001, 6002)]
    df = spark.createDataFrame(many, MAP)
    gaps, isles, depth = [], {}, []
    for contig in {m[0] for m in many}:
        reach, island, of = None, 0, sorted((s, q, e) for c, q, s, e in many if c == contig)
        for s, q, e in of:
            if reach is not None and s > reach:
                gaps.append((contig, q, s, reach))
                island += 1
            reach = e if reach is None else max(reach, e)
            n, a, b = isles.get((contig, island), (0, s, e))
            isles[contig, island] = (n + 1, min(a, s), max(b, e))
        cuts = sorted({s for s, _, _ in of} | {e + 1 for _, _, e in of})
        depth += [(contig, a, b - 1, sum(s <= a <= e for s, _, e in of)) for a, b in zip(cuts, cuts[1:])]
    assert rows(intervals.holes(df)) == sorted(gaps, key=str)
    assert rows(intervals.islands(df)) == sorted(((*k, *v) for k, v in isles.items()), key=str)
    for size in (1, 100, 10**6):
        assert rows(intervals.coverage(df, size)) == sorted(depth, key=str)
    empty = df.limit(0)
    assert intervals.holes(empty).count() == intervals.islands(empty).count() == intervals.coverage(empty).count() == 0


def test_collated_and_deduped(spark):
    parts = [(1, 1, 1, 10, 1, 10, 1), (1, 1, 12, 20, 12, 20, 1), (1, 1, 22, 30, 23, 31, 1), (1, 1, 40, 50, 41, 51, 1), (1, 2, 1, 10, 91, 100, -1), (1, 2, 13, 20, 81, 88, -1)]
    df = spark.createDataFrame(parts, SEG)
    assert rows(intervals.collated(df, 2)) == [(1, 1, 1, 1, 20, 1, 20, 1), (1, 1, 2, 22, 30, 23, 31, 1), (1, 1, 3, 40, 50, 41, 51, 1), (1, 2, 1, 1, 20, 81, 100, -1)]
    assert intervals.collated(df, 0).count() == 6 and rows(intervals.collated(df, 9))[1] == (1, 1, 2, 22, 50, 23, 51, 1)
    tags = spark.createDataFrame([(1, 1, "A", 1, 5), (2, 1, "A", 1, 5), (3, 1, "A", 4, 3000), (4, 1, "A", 2500, 2600), (5, 1, "A", 3001, 3002), (6, 1, "B", 2, 3)],
                                 "tag_id long, contig_id long, tagtype string, cstart int, cfinal int")
    assert rows(intervals.deduped_tags(tags, merge=True)) == [(1, "A", 1, 3000, 4), (1, "A", 3001, 3002, 1), (1, "B", 2, 3, 1)]
    assert (1, "A", 1, 5, 2) in rows(intervals.deduped_tags(tags)) and intervals.deduped_tags(tags).count() == 5


def test_compared_and_carried(spark):
    child = spark.createDataFrame([(9, 1, 101, 110, 1, 10, 1), (9, 2, 201, 210, 1, 10, -1), (9, 3, 1, 5, 1, 5, -1)], SEG)
    parent = spark.createDataFrame([(4, 1, 3, 12, 3, 12, 1), (4, 2, 21, 30, 1, 10, 1), (4, 3, 11, 13, 2, 4, -1)], SEG)
    pairs = spark.createDataFrame([(9, 4)], EDGE)
    # read 1: child = parent + 100; read 2: child = 231 - parent; read 3, both reversed: base 4 lies at 2 and at 11
    assert rows(mappings.compared(child, parent, pairs)) == [(9, 4, 1, 1, 100, 3, 10, 1), (9, 4, 2, -1, 231, 1, 10, 1), (9, 4, 3, 1, -9, 2, 4, 1)]
    strings = spark.createDataFrame([(1, "ACGTAAACCC"), (2, None)], "seq_id long, dna string")
    pieces = spark.createDataFrame([(9, 1, 1, 4, 1, 4, 1), (9, 1, 7, 9, 5, 7, 1), (8, 1, 1, 4, 7, 10, -1)], SEG)
    assert rows(mappings.carried(pieces, strings)) == [(8, 1, "GGGT"), (9, 1, "ACGT--AAA")]
    assert rows(mappings.extents(pieces, "contig_id")) == [(8, 1, 4, 7, 10), (9, 1, 9, 1, 7)]
    assert [r["part"] for r in mappings.parts(pieces).orderBy("contig_id", "x0").collect()] == [1, 1, 2]


def test_activity(spark):
    log = spark.createDataFrame([(1, 0, "import", datetime(2000, 1, 1), datetime(2000, 1, 2)), (2, 0, "export", datetime(2000, 3, 2), None), (3, 1, "export", datetime(2000, 6, 1), datetime(2000, 6, 2))],
                                "id long, project_id int, action string, starttime timestamp, endtime timestamp")
    moves = spark.createDataFrame([(1, 0, 1, 5, 5, date(2001, 1, 1), "done"), (2, 1, 2, 5, 6, date(2002, 1, 1), "pending"), (77, 0, 9, 5, 5, date(2001, 1, 1), "pending")],
                                  "contig_id long, old_project_id int, new_project_id int, requester int, owner int, opened date, status string")
    known = contigs(spark).where("project_id is not null")
    assert rows(activity.last_change(known, log, moves)) == [(0, datetime(2001, 1, 1)), (1, datetime(2001, 1, 1))]
    assert rows(activity.export_pending(known, log)) == [(0, True), (1, False)]
    assert rows(activity.last_added(known)) == [(0, 2), (1, 3)] and rows(activity.latest_note(log)) == [(0, 1)]
    assert rows(activity.transfer_counts(moves)) == [(date(2001, 1, 1), 1, 1)] and rows(activity.last_transfer_out(moves)) == [(0, date(2001, 1, 1))]
    projects = spark.createDataFrame([(0,), (1,), (2,)], "project_id int")
    assert rows(activity.not_reassigned(moves, known, projects, [2])) == [(2, "locked"), (77, "missing project")]
    assert rows(activity.contigs_by_month(contigs(spark)))[0] == (2000, 1, 1, 2, 10) and activity.contigs_by_month(contigs(spark)).count() == 3
    assert [r["contig_id"] for r in activity.top(known, 2, longer=5).collect()] == [2, 1]
    assert rows(activity.latest(log, "import").select("project_id", F.year("last_end"))) == [(0, 2000)]


def test_chains_of_many_components(spark):
    """Components that share a task stay apart; a link to an unknown item is no link."""
    items = spark.createDataFrame([(k, -k) for k in range(60)], "item long, rank long")
    linked = [(k, "R", k + 1, "L", 3, 10 + k) for k in range(0, 60, 2)]
    both = linked + [(b, t, a, s, n, g) for a, s, b, t, n, g in linked] + [(1, "R", 99, "L", 9, 5), (99, "L", 1, "R", 9, 5)]
    made = rows(scaffolds.chained(items, spark.createDataFrame(both, "one long, side string, other long, other_side string, n long, gap long")))
    assert made == sorted([(k + 1, 1, k, "F", None) for k in range(0, 60, 2)] + [(k + 1, 2, k + 1, "F", 10 + k) for k in range(0, 60, 2)], key=str)
