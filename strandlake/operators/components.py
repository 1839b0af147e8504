"""Connected components of an edge table, and the subgraphs of contigs that bridges hold together."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster names; a local session may have one of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="strandlake-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def kept(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    shared(df.sparkSession)
    return df.checkpoint()


def settled(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder and read again: for loops of joins, where the size that a checkpoint takes over from
    its plan is a product that gets longer with every round, and where the true size lets small tables be broadcast."""
    spark = df.sparkSession
    path = f"{shared(spark)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(edges: DataFrame) -> DataFrame:
    """node, root (least node of its component) for every node of ``edges`` (a, b); rows with a null are no edges.

    In each round a node takes the least root among its own, its neighbours' and its root's, and a root the least that any of its
    nodes has met, so that trees merge as a whole and long paths take few rounds; roots only fall, so it ends when their sum
    stays.  A node of very many edges and a root of very many nodes are aggregated before the shuffle.
    """
    both = settled(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a is not null and b is not null").distinct())
    roots = settled(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")))
    total = roots.agg(F.sum(F.col("root").cast("decimal(38,0)"))).first()[0]
    while True:
        near = both.join(roots.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("root").alias("near"))
        met = settled(roots.join(near, roots["node"] == near["a"]).select("node", "root", "near"))
        hooked = met.groupBy("root").agg(F.min("near").alias("hook"))
        jump = met.select(F.col("node").alias("root"), F.least("root", "near").alias("beyond")).join(hooked, "root")
        taken = met.join(jump, "root").select("node", F.least("root", "near", "beyond", "hook").alias("root"))
        roots = settled(taken)
        now = roots.agg(F.sum(F.col("root").cast("decimal(38,0)"))).first()[0]
        if now == total:
            return roots
        total = now


def subgraphs(bridges: DataFrame, least_templates: int = 2) -> DataFrame:
    """contig_id, seed (least contig of its subgraph) over bridges (a, b, templates) with enough templates."""
    found = components(bridges.where(F.col("templates") >= least_templates).select("a", "b"))
    return found.select(F.col("node").alias("contig_id"), F.col("root").alias("seed"))
