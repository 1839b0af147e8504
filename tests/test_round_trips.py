"""Round trips through text files: letters are formatted once a text, travel with documents only, and are digested where they are read."""

import pytest

from strandlake.queries import QUERIES
from strandlake.sources import exchange, files

DATA = "/root/testdata/sf0.001"


def plan_of(frame) -> str:
    return frame._sc._jvm.PythonSQLUtils.explainString(frame._jdf.queryExecution(), "formatted")


def test_no_letters_read_back_are_shuffled(spark):
    moved = [block for block in plan_of(QUERIES["sink_caf"](spark, DATA)).split("\n\n") if "Exchange\n" in block]
    assert moved and not [block for block in moved if "body#" in block or "dna#" in block or "quality#" in block]


def test_digests_are_those_of_the_sequences(spark, tmp_path):
    (tmp_path / "in.txt").write_text("\n DNA : a\nac\ngt\n\nBaseQuality : a\n1  2\n3 4\n\nDNA : b\néc\n\nBaseQuality : lost\n1\n\nSequence : a\nIs_read\nStrand Forward\nClipping QUAL 1 2\nClipping SVEC 3 4\n\nNote : x\n\n"
                                     "Sequence : c\nIs_contig\nAssembled_from r 5 9 1 5\nAssembled_from s 7 9 1 3\n\nSequence : d\nIs_contig\n", encoding="utf-8")
    blocks = files.caf_blocks(spark, str(tmp_path / "in.txt"))
    want = files.caf_sequences(blocks).selectExpr("name", "cast(length(dna) as bigint) as n", "md5(dna) as digest", "cast(size(quality) as bigint) as more")
    found = files.caf_digests(blocks)
    assert sorted(map(str, found.collect())) == sorted(map(str, want.collect())) and found.count() == 2
    assert sorted(tuple(map(str, r)) for r in files.caf_heads(blocks).collect()) == [("a", "read", "None", "Forward", "2"), ("a", "read", "None", "Forward", "4"), ("c", "contig", "2", "None", "12")]


@pytest.mark.parametrize("name", ["sink_caf", "src_caf", "sink_fastq", "sink_maf"])
def test_texts_are_formatted_once(spark, monkeypatch, name):
    """What is made of letters stands below the join of contigs with them."""
    seen, folder = [], exchange.shared_folder
    writer = type(spark.range(0).write)
    text = writer.text
    monkeypatch.setattr(writer, "text", lambda self, *a, **b: seen.append(self._df._jdf.queryExecution().optimizedPlan().toString()) or text(self, *a, **b))
    QUERIES[name](spark, DATA).count()
    written = next(plan for plan in seen if "dna#" in plan)
    above = written.split("Join Inner")[0]
    assert folder and "transform(" not in above.replace("transform(segments", "") and "regexp_replace" not in above
