"""Filters with arguments.  Nulls never match a condition; without a condition all rows stay; extra columns stay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of reads that come from the sequencing line.
#: Names that an assembler has added to, as a fixed pattern.
MANGLED_NAME = r"\.[pq][12]k\.[\w\-]+"


def named(column: str, name: str) -> Column:
    """``*`` is a wildcard; a name with ``%`` or ``_`` is a LIKE pattern, any other must be equal."""
    pattern = name.replace("*", "%")
    return F.col(column).like(pattern) if "%" in pattern or "_" in pattern else F.col(column) == pattern


def within(column: str, low=None, high=None) -> Column:
    found = F.lit(True)
    if low is not None:
        found &= F.col(column) >= low
    return found & (F.col(column) <= high) if high is not None else found


def find_reads(reads: DataFrame, placements: DataFrame, name: str, only_free: bool = False) -> DataFrame:
    """Reads of a name with all their placements; a read without one only if its status is PASS."""
    found = reads.where(named("readname", name)).join(placements.withColumnRenamed("seq_id", "read_id"), "read_id", "left")
    free = F.col("contig_id").isNull()
    return found.where(free & (F.col("status") == "PASS") if only_free else ~free | (F.col("status") == "PASS"))


def contigs_by_property(contigs: DataFrame, lineage: DataFrame, scope: str = "initial", **ranges: tuple) -> DataFrame:
    """``ranges``: column=(least, most), either may be None.  ``scope``: all, current (no children) or initial (no parents)."""
    for column, (low, high) in ranges.items():
        contigs = contigs.where(within(column, low, high))
    if scope == "all":
        return contigs
    end = {"initial": "contig_id", "current": "parent_id"}[scope]
    return contigs.join(lineage.select(F.col(end).alias("contig_id")), "contig_id", "left_anti")


def select_reads(reads: DataFrame, after=None, before=None, like=None, unlike=None, matching=None, not_matching=None,
                 status: str | None = "PASS", limit: int | None = None) -> DataFrame:
    """Reads dated from ``after`` and before ``before``, by name patterns (LIKE or regular expressions) and status."""
    tests = [
        (after, lambda v: F.col("asped") >= F.lit(v).cast("date")), (before, lambda v: F.col("asped") < F.lit(v).cast("date")),
        (like, lambda v: F.col("readname").like(v)), (unlike, lambda v: ~F.col("readname").like(v)),
        (matching, lambda v: F.col("readname").rlike(v)), (not_matching, lambda v: ~F.col("readname").rlike(v)),
        (status, lambda v: F.col("status") == v),
    ]
    for value, test in tests:
        if value is not None:
            reads = reads.where(test(value))
    return reads if limit is None else reads.orderBy("readname").limit(limit)


def edited_sequences(versions: DataFrame) -> DataFrame:
    """Rows of (seq_id, read_id, version) that are no original."""
    return versions.where("version > 0")


def contigs_with_tags(contigs: DataFrame, tags: DataFrame, types: list[str] | None = None, ids: list[int] | None = None,
                      comment: str | None = None, lineage: DataFrame | None = None, current: bool = True) -> DataFrame:
    """Contigs that bear a tag of the given types, ids and comment; with ``lineage``, those that are (not) current."""
    if types is not None:
        tags = tags.where(F.col("tagtype").isin(types))
    if ids is not None:
        tags = tags.where(F.col("tag_id").isin(ids))
    if comment is not None:
        tags = tags.where(named("comment", comment))
    found = contigs.join(tags.select("contig_id"), "contig_id", "left_semi")
    if lineage is None:
        return found
    return found.join(lineage.select(F.col("parent_id").alias("contig_id")), "contig_id", "left_anti" if current else "left_semi")


def window_reads(mappings: DataFrame, first: int, last: int, contig_id: int | None = None) -> DataFrame:
    """Mappings that meet positions ``first``..``last``."""
    found = mappings.where((F.col("cfinish") >= first) & (F.col("cstart") <= last))
    return found if contig_id is None else found.where(F.col("contig_id") == contig_id)


def project_inventory(projects: DataFrame, contigs: DataFrame, name: str = "*", assembly: int | None = None, with_empty: bool = False) -> DataFrame:
    projects = projects.where(named("name", name))
    if assembly is not None:
        projects = projects.where(F.col("assembly_id") == assembly)
    return projects if with_empty else projects.join(contigs.select("project_id"), "project_id", "left_semi")


def in_projects(contigs: DataFrame, projects: DataFrame, include: list[str] | None = None, exclude: list[str] = (), longer: int = 0) -> DataFrame:
    """Contigs longer than ``longer`` in projects of the given names."""
    chosen = projects.where(~F.col("name").isin(list(exclude))) if exclude else projects
    chosen = chosen if include is None else chosen.where(F.col("name").isin(include))
    return contigs.where(F.col("length") > longer).join(chosen.select("project_id", "name"), "project_id")


def counted_again(mappings: DataFrame) -> DataFrame:
    return mappings.groupBy("contig_id").agg(F.count("*").alias("nreads"))


def without_short(mappings: DataFrame, span: int) -> DataFrame:
    """Mappings longer than ``span`` on the contig."""
    return mappings.where(F.col("cfinish") - F.col("cstart") + 1 > span)


def invalid_names(reads: DataFrame, pattern: str = MANGLED_NAME) -> DataFrame:
    """Reads whose name matches the pattern anywhere; a null name doesn't."""
    return reads.where(F.col("readname").rlike(pattern))


def valid_names(reads: DataFrame, pattern: str = MANGLED_NAME) -> DataFrame:
    """The other reads."""
    return reads.where(~F.coalesce(F.col("readname").rlike(pattern), F.lit(False)))


def without_reads(mappings: DataFrame, names: DataFrame) -> DataFrame:
    """Mappings but those of the reads (read_id) listed."""
    return mappings.join(names.select(F.col("read_id").alias("seq_id")), "seq_id", "left_anti")


def history_range(rows: DataFrame, column: str, first, last, **equal) -> DataFrame:
    """Rows dated from ``first`` to ``last``, both included, and equal to the given values (project_id=, owner= ...)."""
    found = rows.where(F.col(column).between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    for name, value in equal.items():
        found = found.where(F.col(name) == value)
    return found


def transfer_requests(requests: DataFrame, requester: int | None = None, owner: int | None = None, active: bool = False) -> DataFrame:
    """Requests that aren't cancelled; asked for by a requester, only those about contigs of others."""
    found = requests.where(F.col("status").isin("pending", "approved") if active else F.col("status") != "cancelled")
    if owner is not None:
        return found.where(F.col("owner") == owner)
    found = found.where(F.col("requester") != F.col("owner"))
    return found if requester is None else found.where(F.col("requester") == requester)


def transfer_candidates(requests: DataFrame, current: DataFrame) -> DataFrame:
    """request_id and why a pending request can't be carried out; ``active`` if nothing speaks against it.

    A contig that isn't current can't move, nor can one that an earlier request, pending or approved, asks for; nor one that has left the
    project the request names.
    """
    now = current.select("contig_id", F.col("project_id").alias("now"))
    first = requests.where(F.col("status").isin("pending", "approved")).groupBy("contig_id").agg(F.min("request_id").alias("first"))
    reason = F.when(F.col("now").isNull(), "not current").when(F.col("first") < F.col("request_id"), "already requested")
    reason = reason.when(F.col("now") != F.col("old_project_id"), "project changed").otherwise("active")
    return requests.where("status = 'pending'").join(now, "contig_id", "left").join(first, "contig_id", "left").select("request_id", reason.alias("reason"))
