"""Readers of text formats on small files with odd records, and components against a plain search."""

import random

from strandlake.operators.components import components
from strandlake.sources import exchange, files


def saved(tmp_path, text: str) -> str:
    path = tmp_path / "in.txt"
    path.write_text(text)
    return str(path)


def rows(df):
    return sorted(tuple(str(v) for v in r) for r in df.collect())


def test_fasta(spark, tmp_path):
    path = saved(tmp_path, ">a first\nacgt\nno dna!\nac\n>b\n>c\nt\n")
    assert rows(files.read_fasta(spark, path)) == [("a", "acgtac"), ("b", ""), ("c", "t")]


def test_fasta_lines_are_cut_and_joined_again(spark, tmp_path):
    given = [("x", "a" * 60), ("y", "c" * 121), ("z", "")]
    exchange.write_fasta(spark.createDataFrame(given, "name string, dna string"), str(tmp_path / "out"))
    assert max(len(line) for p in (tmp_path / "out").glob("part*") for line in p.read_text().split("\n")) == 60
    assert rows(files.read_fasta(spark, str(tmp_path / "out"))) == given


def test_fasta_quality(spark, tmp_path):
    path = saved(tmp_path, ">a\n10 20\n30\n>b\n")
    assert rows(files.read_fasta_quality(spark, path)) == [("a", "[10, 20, 30]"), ("b", "[]")]


def test_caf(spark, tmp_path):
    text = (
        'Sequence : c1\nIs_contig\nAssembled_from r1 1 5 5 1\nTag OLIG 2 3 "note\\n\\\nmore"\n\nDNA : c1\nac\ngt\n\n'
        "BaseQuality : c1\n1 2 3 4\n\nSequence : r1\nIs_read\nClipping QUAL 3 9\n"
    )
    blocks = files.caf_blocks(spark, saved(tmp_path, text))
    assert rows(files.caf_segments(blocks)) == [("c1", "r1", "1", "5", "5", "1")]
    assert rows(files.caf_tags(blocks)) == [("c1", "OLIG", "2", "3", "note more")]
    assert rows(files.caf_clips(blocks)) == [("r1", "QUAL", "3", "9")]
    assert rows(files.caf_sequences(blocks)) == [("c1", "acgt", "[1, 2, 3, 4]")]


def test_embl(spark, tmp_path):
    path = saved(tmp_path, "ID   c1; x\nFT   CDS   3..9\nFT   REPT   complement(4..8)\n//\nID   c2\n//\n")
    assert rows(files.read_embl(spark, path)) == [("c1", "CDS", "3", "9", "F"), ("c1", "REPT", "4", "8", "R")]


def test_experiment(spark, tmp_path):
    path = saved(tmp_path, "ID   r1\nTN   t1\nSI   500..1500\nQL   3\nTG   A 1\nTG   B 2\nSQ\n     acg\n     t\n//\nTN   none\n//\n")
    (one,) = files.read_experiment(spark, path).collect()
    assert (one.name, one.template, one.si_low, one.si_high, one.qleft, one.qright, one.tags, one.dna) == (
        "r1", "t1", 500, 1500, 3, None, ["A 1", "B 2"], "acgt"
    )


def test_crossmatch(spark, tmp_path):
    path = saved(tmp_path, "Maximal\n 90 1.0 0.5 0.0 r1 1 90 (3) c1 11 100 (7)\n 30 0.0 0.0 0.0 r2 1 30 (0) c c1 (5) 95 66\n")
    found = files.read_crossmatch(spark, path)
    got = [(r.one, r.turned, r.two, r.two_first, r.two_last, r.two_tail) for r in found.orderBy("one").collect()]
    assert got == [("r1", False, "c1", 11, 100, 7), ("r2", True, "c1", 95, 66, 5)]
    assert files.read_crossmatch(spark, path, least=50).count() == 1


def test_list(spark, tmp_path):
    assert rows(files.read_list(spark, saved(tmp_path, "# head\na\t3\n\nb\n"))) == [("a", "3"), ("b", "None")]


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(20)]
    near, want = {}, {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for start in sorted(near):
        todo = [start]
        while todo:
            if (x := todo.pop()) not in want:
                want[x] = start
                todo.extend(near[x])
    found = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.root for r in found} == want and len(found) == len(want)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
