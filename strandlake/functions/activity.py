"""Counts over time, transfers between projects, imports and exports.  Rows without a date take no part; empty tables give no rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_month(rows: DataFrame, column: str, *measures) -> DataFrame:
    """yr, mon and the measures (aggregates) of each month."""
    return rows.where(F.col(column).isNotNull()).groupBy(F.year(column).alias("yr"), F.month(column).alias("mon")).agg(*measures)


def contigs_by_month(contigs: DataFrame) -> DataFrame:
    return by_month(contigs, "created", F.count("*").alias("contigs"), F.sum("nreads").cast("long").alias("nreads"), F.sum("length").cast("long").alias("total_length"))


def reads_by_month(reads: DataFrame, status: str | None = "PASS") -> DataFrame:
    """Reads per month of ``asped``; of one status unless None."""
    return by_month(reads if status is None else reads.where(F.col("status") == status), "asped", F.count("*").alias("reads"))


def strand_counts(reads: DataFrame) -> DataFrame:
    """template_id, forward_reads, reverse_reads."""
    n = lambda strand: F.count_if(F.col("strand") == strand).alias(f"{strand.lower()}_reads")
    return reads.groupBy("template_id").agg(n("Forward"), n("Reverse"))


def top(contigs: DataFrame, n: int = 100, longer: int = 0) -> DataFrame:
    """The ``n`` longest contigs over a length; the lowest ids if tied."""
    return contigs.where(F.col("length") > longer).orderBy(F.col("length").desc(), "contig_id").limit(n)


def last_added(contigs: DataFrame) -> DataFrame:
    """project_id, contig_id: the newest contig of each project, the highest id if tied."""
    return contigs.groupBy("project_id").agg(F.max(F.struct("created", "contig_id")).alias("m")).select("project_id", "m.contig_id")


def latest(log: DataFrame, action: str | None = None) -> DataFrame:
    """project_id, action, last_start, last_end of the log of imports and exports."""
    log = log if action is None else log.where(F.col("action") == action)
    return log.groupBy("project_id", "action").agg(F.max("starttime").alias("last_start"), F.max("endtime").alias("last_end"))


def latest_note(log: DataFrame, action: str = "import") -> DataFrame:
    """project_id, latest: the highest entry of an action."""
    return log.where(F.col("action") == action).groupBy("project_id").agg(F.max("id").alias("latest"))


def transfer_counts(requests: DataFrame, status: str = "done", own: bool = True) -> DataFrame:
    """day, project_id, n: requests of a status by the day of opening and the project that receives; only those of the owner if ``own``."""
    at = requests.where(F.col("status") == status)
    at = at.where("requester = owner") if own else at
    return at.groupBy(F.col("opened").cast("date").alias("day"), F.col("new_project_id").alias("project_id")).agg(F.count("*").alias("n"))


def last_transfer_out(requests: DataFrame) -> DataFrame:
    """project_id, closed: the last transfer that was done out of each project."""
    return requests.where("status = 'done'").groupBy(F.col("old_project_id").alias("project_id")).agg(F.max("opened").alias("closed"))


def last_change(current: DataFrame, log: DataFrame, requests: DataFrame) -> DataFrame:
    """project_id, changed: the newest contig, finished import or transfer in or out of each project."""
    stamp = lambda df, project, column: df.select(F.col(project).alias("project_id"), F.col(column).cast("timestamp").alias("t"))
    done = requests.where("status = 'done'")
    each = stamp(current, "project_id", "created").unionByName(stamp(log.where("action = 'import' and endtime is not null"), "project_id", "endtime"))
    each = each.unionByName(stamp(done, "new_project_id", "opened")).unionByName(stamp(done, "old_project_id", "opened"))
    return each.groupBy("project_id").agg(F.max("t").alias("changed"))


def export_pending(current: DataFrame, log: DataFrame) -> DataFrame:
    """project_id, pending: whether a current contig is newer than the last finished export, or there was none."""
    newest = current.groupBy("project_id").agg(F.max(F.col("created").cast("timestamp")).alias("t"))
    exported = log.where("action = 'export'").groupBy("project_id").agg(F.max(F.col("endtime").cast("timestamp")).alias("e"))
    return newest.join(exported, "project_id", "left").select("project_id", (F.col("e").isNull() | F.coalesce(F.col("t") > F.col("e"), F.lit(False))).alias("pending"))


def not_reassigned(moves: DataFrame, contigs: DataFrame, projects: DataFrame, locked: list[int]) -> DataFrame:
    """contig_id, reason of moves (contig_id, new_project_id) that can't be made: a known contig goes to a locked project, or the project is missing."""
    held = moves.where(F.col("new_project_id").isin(locked)).join(contigs.select("contig_id"), "contig_id", "left_semi").select("contig_id", F.lit("locked").alias("reason"))
    lost = moves.select("contig_id", F.col("new_project_id").alias("project_id")).join(projects.select("project_id"), "project_id", "left_anti")
    return held.unionByName(lost.select("contig_id", F.lit("missing project").alias("reason"))).distinct()
