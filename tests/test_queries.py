"""Assembly queries against DuckDB on the smallest tables."""

import duckdb
import pytest

from strandlake.plans.model import needed, with_views
from strandlake.plans.assembly import TABLES, Assembly
from strandlake.queries import CHAINS, ORACLES, QUERIES
from strandlake.sources.exchange import with_quality

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    found = duckdb.connect()
    for t in TABLES:
        found.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return found


@pytest.mark.parametrize(
    "name", ["project_summary", "cur_contigs_asof", "contig_holes", "contig_islands", "coverage_depth", "map_multiply", "overlap_best", "lineage_age", "tag_remap", "segment_collate",
             "consensus_bayes", "link_contigs", "project_history", "sink_caf", "kmer_segments", "chk_integrity"]
)
def test_same_rows(spark, duck, name):
    mine = QUERIES[name](spark, DATA)
    theirs = duck.execute(ORACLES[name])
    names = [d[0] for d in theirs.description]
    assert sorted(names) == sorted(mine.columns)
    flat = lambda rows: sorted(tuple(str(v)[:10] if hasattr(v, "year") else str(int(v)) if isinstance(v, float) and v == int(v) else str(v) for v in r) for r in rows)
    assert flat(mine.select(names).collect()) == flat(theirs.fetchall())


def test_every_query_has_an_oracle():
    assert QUERIES.keys() - ORACLES.keys() == CHAINS and ORACLES.keys() <= QUERIES.keys()


def test_history_crosses_nothing(spark):
    for name in ("project_history", "organism_history", "weekly_monthly_series"):
        plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan, name


def test_views_of_the_session_stay(spark):
    spark.range(3).createOrReplaceTempView("orders")
    QUERIES["cur_contigs"](spark, DATA).count()
    assert spark.table("orders").count() == 3
    spark.catalog.dropTempView("orders")


def test_views_come_in_order():
    order = needed("select * from a_place")
    assert order.index("a_read") < order.index("a_base") < order.index("a_map") < order.index("a_curmap")
    assert "materialized" in with_views("select * from a_cur", duck=True)


def test_long_runs_of_other_letters(spark, tmp_path):
    runs = [(1, "ab" + " -1_é" * 40_000 + "cd"), (2, "0123"), (3, None)]
    spark.createDataFrame(runs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted((r["seq_id"], r["dna"]) for r in Assembly(spark, str(tmp_path)).dna.collect()) == [(1, "ACGT"), (2, "")]
    assert "(\\W|_|0|" in with_views("select * from a_dna", duck=True)


@pytest.mark.parametrize("name", ["read_completeness", "chk_read_sequence", "single_read_contigs", "fn_padded_quality", "low_quality_reads"])
def test_letters_travel_with_documents_only(spark, name):
    plan = QUERIES[name](spark, DATA)._sc._jvm.PythonSQLUtils.explainString(QUERIES[name](spark, DATA)._jdf.queryExecution(), "formatted")
    moved = [block for block in plan.split("\n\n") if "Exchange\n" in block and ("dna#" in block or "quality#" in block)]
    assert moved and all("hashpartitioning(__doc" in block or "BroadcastExchange" in block for block in moved)


def test_letters_are_those_of_the_view(spark):
    a = Assembly(spark, DATA)
    mine = a.lettered(a.readinfo.select("read_id"), "read_id").select("read_id", "dna", "quality")
    assert sorted(mine.collect()) == sorted(with_quality(a.readseq).select("read_id", "dna", "quality").collect())
