"""A training corpus from ``documents``: judge, drop near copies, decontaminate, mix, shard.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before has kept.  All but the last
return the columns of ``documents``; the last adds slot and shard.

Edge cases: rows with a null or empty text have fewer than ten words, so the first stage drops them; rows with a null id or source are
treated like others (see the operators).  Repeated rows and ties leave one row of each group after the second stage; mixing may repeat it
again.  Very long texts pass whole.  Columns of ``documents`` beyond doc_id, text, source and n_chars pass untouched.  An empty table
gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from strandlake.llm import decontaminate, jaccard_join, mixing, quality_rules, sharding
from strandlake.llm.batches import cut, dropped, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules go."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return jaccard_join.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out of the texts."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are left out or repeated, so that sources reach their targets."""
    return mixing.mix(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row gets its shard."""
    return sharding.place(docs)


STAGES = [
    ("quality rules", quality),
    ("near copies", near_copies),
    ("decontamination", decontaminated),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: The first stage hashes n-grams and the last but one follows it, so no SQL says the same; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet to the shared folder and read again by the next.

    A folder goes as soon as the next one is written; the last one stays, as the result is read from it.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    folder = spark.conf.get("spark.checkpoint.dir", None)
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        if folder:
            path = f"{folder.rstrip('/')}/corpus-{uuid.uuid4().hex}-{k}"
            out.write.parquet(path)
            docs = spark.read.parquet(path)
            if before:
                dropped(spark, before)
            before = path
        else:
            docs = cut(out)
    return docs
