r"""Mixing sources to target weights by systematic sampling.

A document's size is its number of words ``[^\x20\x09-\x0D]+``.  Sources, in code-point order with null last, weigh
5, 2, 1, repeating; their targets share the sum of all sizes by weight, but none exceeds ``cap`` times its
source's size, and what a capped source leaves is shared by weight among the others (water filling).

Every document of a source is expected ``target / size of the source`` times.  The expected copies are summed
along the source's documents, one random offset (a hash of the source) is added, and a copy is taken at every
integer that is passed.  Documents stand in order of size, so the words taken follow the target closely, and by
a hash of the id within a size.  The running sum needs no ordered pass over a source: documents fall into
buckets (source, size band, hash bucket); the buckets before are counted by two small windows over bands and
over hash buckets, and only a bucket's own rows are ranked together.

Edge cases: a null or empty text has size 0 and is copied like any other, but takes no words.  A source without
words has target 0 and takes nothing.  A null source is a source of its own.  Documents without an id are told apart
by their text.  Rows that agree in id, source, size and (without an id) text are interchangeable: they are counted together and share
their copies in turn.  Texts of any length are counted whole.  Further columns stay, whatever their names.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.llm.batches import BLANKS, table

WEIGHTS = (5, 2, 1)
HASHES = 4096


def words_in(text: str) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")).cast("long")


def tie(text: str) -> Column:
    """What tells documents without an id apart: the MD5 of their text."""
    return F.when(F.col("doc_id").isNull(), F.md5(F.coalesce(text, F.lit("")))).alias("tie")


def unit(text: Column) -> Column:
    """A number from 0 to 1 made of the first eight hex digits of an MD5."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def targets(sizes: DataFrame, cap: int = 3) -> DataFrame:
    """__src, __no_src, source_size, target, rate and offset; ``sizes`` has __src, __no_src and words per source.

    One row per source: the windows without keys stand over this aggregate only.
    """
    everywhere, ordered = W.partitionBy(), W.orderBy("__no_src", "__src")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(ordered) - 1) % len(WEIGHTS) + 1).cast("int")).cast("long")
    at = sizes.withColumn("w", weight).withColumn("total", F.sum("source_size").over(everywhere))
    # water filling: sources by the level at which they are full; the first level that is high enough is the one
    at = at.withColumn("full", F.col("source_size") * float(cap) / F.col("w"))
    filling = W.orderBy("full", "__no_src", "__src")
    before = F.coalesce(F.sum(F.col("source_size") * cap).over(filling.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("w").over(filling.rowsBetween(0, W.unboundedFollowing))
    at = at.withColumn("level", (F.col("total") - before).cast("double") / left)
    fits = F.when(F.col("level") <= F.col("full"), F.col("level"))
    level = F.first(fits, ignorenulls=True).over(filling.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    at = at.withColumn("target", F.coalesce(F.least(F.col("source_size") * float(cap), level * F.col("w")), F.lit(0.0)))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = unit(F.concat(F.lit("offset:"), F.col("__no_src").cast("string"), F.lit(":"), F.col("__src")))
    return at.select("__src", "__no_src", "source_size", "target", rate.alias("rate"), offset.alias("offset"))


def banded(docs: DataFrame) -> DataFrame:
    """Adds source key, size, size band (eight to an octave) and hash bucket."""
    bits = F.length(F.bin("size")).cast("int")
    band = bits * 16 + F.expr("cast(shiftright(size * 16, length(bin(size))) as int)")
    key = F.coalesce(F.col("doc_id").cast("string"), "tie", F.lit(""))
    return (
        docs.withColumn("__src", F.coalesce("source", F.lit("")))
        .withColumn("__no_src", F.col("source").isNull().cast("int"))
        .withColumn("band", band)
        .withColumn("spread", F.conv(F.substring(F.md5(key), 9, 4), 16, 10).cast("int") % HASHES)
    )


def plan(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, tie, source_size, target, copies, one row per row of ``docs`` (doc_id, source, size, tie if any)."""
    docs = docs if "tie" in docs.columns else docs.withColumn("tie", F.lit(None).cast("string"))
    rows = banded(docs).groupBy("__src", "__no_src", "band", "spread", "doc_id", "size", "tie").agg(F.count("*").alias("rows"))
    cells = rows.groupBy("__src", "__no_src", "band", "spread").agg(F.sum("rows").alias("n"), F.sum(F.col("rows") * F.col("size")).alias("words"))
    bands = cells.groupBy("__src", "__no_src", "band").agg(F.sum("n").alias("n"), F.sum("words").alias("words"))
    upto = lambda *keys: W.partitionBy("__src", "__no_src", *keys[:-1]).orderBy(keys[-1]).rowsBetween(W.unboundedPreceding, -1)
    of = ["__src", "__no_src"]
    in_band = bands.withColumn("lower", F.coalesce(F.sum("n").over(upto("band")), F.lit(0))).select(*of, "band", "lower")
    goals = targets(bands.groupBy(*of).agg(F.sum("words").alias("source_size")))
    before = (
        cells.withColumn("__left", F.coalesce(F.sum("n").over(upto("band", "spread")), F.lit(0)))
        .join(in_band, [*of, "band"])
        .join(goals, of)
        .select(*of, "band", "spread", (F.col("lower") + F.col("__left")).alias("before"), "source_size", "target", "rate", "offset")
    )
    keys = [*of, "band", "spread"]
    within = W.partitionBy(*keys).orderBy("size", F.col("doc_id").asc_nulls_first(), F.col("tie").asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)
    ranked = rows.withColumn("in_cell", F.coalesce(F.sum("rows").over(within), F.lit(0))).join(before, keys)
    each = ranked.withColumn("rank", F.explode(F.expr("sequence(before + in_cell + 1, before + in_cell + rows)")))
    passed = lambda k: F.floor(k * F.col("rate") + F.col("offset"))
    return each.select(
        "doc_id",
        F.when(F.col("__no_src") == 0, F.col("__src")).alias("source"),
        "size", "tie", "source_size", "target",
        (passed(F.col("rank")) - passed(F.col("rank") - 1)).cast("long").alias("copies"),
    )


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", words_in("text").alias("size"), tie("text"))
    return plan(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as often as it is taken; copies are whole rows, ids included.

    Copies are joined back by id, source and size.  Rows that agree in all three but not in their text take the
    sum of their copies in turn.
    """
    keyed = docs.withColumn("__size", words_in("text")).withColumn("__tie", tie("text"))
    copies = plan(keyed.select("doc_id", "source", F.col("__size").alias("size"), F.col("__tie").alias("tie"))).groupBy(
        F.col("doc_id").alias("__id"), F.col("source").alias("__from"), F.col("size").alias("__words"), F.col("tie").alias("__other")
    ).agg(F.sum("copies").alias("__copies"), F.count("*").alias("__rows"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("source").eqNullSafe(F.col("__from")) & (F.col("__size") == F.col("__words"))
    same &= F.col("__tie").eqNullSafe(F.col("__other"))
    joined = keyed.join(copies, same).drop("__id", "__from", "__words", "__size", "__other")
    alone = joined.where("__rows = 1").withColumn("__take", F.col("__copies"))
    turn = F.row_number().over(W.partitionBy("doc_id", "source", "__copies", "__rows", "__tie", words_in("text")).orderBy("text"))
    shared = joined.where("__rows > 1").withColumn("__turn", turn).withColumn(
        "__take", F.floor(F.col("__copies") * F.col("__turn") / F.col("__rows")) - F.floor(F.col("__copies") * (F.col("__turn") - 1) / F.col("__rows"))
    ).drop("__turn")
    taken = alone.unionByName(shared).where("__take > 0")
    return taken.withColumn("__copy", F.explode(F.expr("sequence(1, cast(__take as int))"))).select(docs.columns)


OP7_SQL = r"""
with sized as (
  select doc_id, source, coalesce(source, '') as src, cast(source is null as int) as no_src,
         cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
         case when doc_id is null then md5(coalesce(text, '')) end as tie
  from documents),
sources as (
  select src, no_src, cast(sum(size) as bigint) as source_size,
         [5, 2, 1][cast((row_number() over (order by no_src, src) - 1) % 3 + 1 as int)] as w
  from sized group by src, no_src),
levels as (
  select *, source_size * 3.0::double / w as full_at, cast(sum(source_size) over () as bigint) as total from sources),
filled as (
  select *, cast(total - coalesce(sum(source_size * 3) over (order by full_at, no_src, src rows between unbounded preceding and 1 preceding), 0) as double)
         / cast(sum(w) over (order by full_at, no_src, src rows between current row and unbounded following) as double) as lev
  from levels),
goals as (
  select src, no_src, source_size,
         coalesce(least(source_size * 3.0::double, (first_value(case when lev <= full_at then lev end ignore nulls)
           over (order by full_at, no_src, src rows between unbounded preceding and unbounded following)) * w), 0.0::double) as target,
         cast('0x' || substr(md5('offset:' || no_src || ':' || src), 1, 8) as bigint) / 4294967296.0::double as u
  from filled),
ranked as (
  select s.*, row_number() over (partition by src, no_src order by
           length(bin(size)) * 16 + ((size * 16) >> length(bin(size))),
           cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), tie, '')), 9, 4) as bigint) % 4096, size, doc_id nulls first, tie nulls first) as k
  from sized s)
select doc_id, size, source_size, target,
       cast(floor(k * r + u) - floor((k - 1) * r + u) as bigint) * size as taken
from (select ranked.*, source_size, target, u, case when source_size > 0 then target / source_size else 0.0 end as r
      from ranked join goals using (src, no_src)) x
"""
