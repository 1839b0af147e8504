"""Statistics of contigs, reads and projects.  Empty inputs give no rows (a total of nothing is no row); null lengths count as none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def n50(contigs: DataFrame, *keys: str) -> DataFrame:
    """Keys, n50: the length at which the descending running sum first exceeds half of the total (0 if it never does).

    Contigs of one length are summed first, so a key's window holds its different lengths, however many contigs it has.
    """
    sizes = contigs.groupBy(*keys, "length").agg(F.sum("length").alias("mass"))
    run = F.sum("mass").over(W.partitionBy(*keys).orderBy(F.col("length").desc()))
    total = F.sum("mass").over(W.partitionBy(*keys))
    over = sizes.withColumn("run", run).withColumn("total", total)
    # the run passes half of the total within the first length whose run does
    return over.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col("run") > F.floor(F.col("total") / 2), F.col("length"))), F.lit(0)).cast("long").alias("n50"))


def totals(contigs: DataFrame, *keys: str) -> DataFrame:
    return contigs.groupBy(*keys).agg(
        F.count("*").alias("contigs"), F.sum("nreads").cast("long").alias("nreads"), F.sum("length").cast("long").alias("total_length"),
        F.round(F.avg("length")).cast("long").alias("mean_length"), F.round(F.stddev_pop("length")).cast("long").alias("sd_length"),
        F.max("length").alias("max_length"),
    )


def project_summary(contigs: DataFrame, least_length: int = 0, least_reads: int = 1) -> DataFrame:
    """Per project over contigs of a least length and number of reads: totals, newest contig and N50."""
    chosen = contigs.where((F.col("length") >= least_length) & (F.col("nreads") >= least_reads))
    newest = chosen.groupBy("project_id").agg(F.max("created").alias("newest"))
    return totals(chosen, "project_id").join(newest, "project_id").join(n50(chosen, "project_id"), "project_id")


def tiers(contigs: DataFrame, least_lengths=(0, 2000, 5000, 10_000, 100_000), more_reads_than: int = 2) -> DataFrame:
    """The totals of every tier of least length and project, in one aggregation."""
    each = contigs.where(F.col("nreads") > more_reads_than).withColumn("tier", F.explode(F.filter(F.array(*map(F.lit, least_lengths)), lambda t: t <= F.col("length"))))
    return totals(each, "tier", "project_id").drop("sd_length")


def report(contigs: DataFrame, projects: DataFrame, exclude=("BIN", "FREEASSEMBLY", "TRASH")) -> DataFrame:
    """The project table with a TOTAL row, each with its N50."""
    at = contigs.join(projects.where(~F.col("name").isin(list(exclude))).select("project_id", "name"), "project_id")
    all_of = at.withColumn("name", F.lit("TOTAL"))
    each = at.unionByName(all_of)
    return totals(each, "name").drop("mean_length", "sd_length").join(n50(each, "name"), "name")


def contig_statistics(mappings: DataFrame) -> DataFrame:
    """Range, length, average cover (two decimals) and shift to position 1 of every contig, and the reads at its ends.

    Of several reads at an end the one of the shortest span stands there, then that of the lowest id.
    """
    span = F.col("cfinish") - F.col("cstart") + 1
    ends = mappings.groupBy("contig_id").agg(
        F.min("cstart").alias("first_base"), F.max("cfinish").alias("last_base"), F.sum(span).alias("bases"),
        F.min(F.struct("cstart", span.alias("span"), "seq_id")).alias("l"), F.min(F.struct((-F.col("cfinish")).alias("f"), span.alias("span"), "seq_id")).alias("r"),
    )
    length = F.col("last_base") - F.col("first_base") + 1
    cover = F.floor((F.col("bases") * 200 + length) / (length * 2)).cast("double") / 100
    return ends.select("contig_id", "first_base", "last_base", length.alias("length"), cover.alias("cover"), (1 - F.col("first_base")).alias("zero_shift"),
                       F.col("l.seq_id").alias("left_read"), F.col("r.seq_id").alias("right_read"))


def base_qualities(bases: DataFrame, key: str = "seq_id") -> DataFrame:
    """Key (null: all), base (null: all), n, mean and rms of qualities, and pads per other base, by grouping sets."""
    grouped = bases.rollup(key, "base") if key else bases.rollup("base")
    return grouped.agg(
        F.count("*").alias("n"), F.avg("q").alias("mean"), F.sqrt(F.avg(F.col("q") * F.col("q"))).alias("rms"),
        (F.count(F.when(F.col("base") == " ", 1)) / F.nullif(F.count(F.when(F.col("base") != " ", 1)), F.lit(0))).alias("pad_rate"),
    )


def as_of(contigs: DataFrame, edges: DataFrame) -> DataFrame:
    """contigs with ``gone``, the day of their newest child (null for current ones)."""
    born = contigs.select("contig_id", F.col("created").alias("d"))
    gone = edges.join(born, "contig_id").groupBy("parent_id").agg(F.max("d").alias("gone")).withColumnRenamed("parent_id", "contig_id")
    return contigs.join(gone, "contig_id", "left")


def lived(contigs: DataFrame, edges: DataFrame, step: str = "month", more_reads_than: int = 1) -> DataFrame:
    """contigs, each once for every ``day`` (start of a day, week or month) after its creation and before its newest child's.

    Days run to the start of the step of the newest contig.  A contig meets only the days of its own life, so nothing is crossed.
    """
    at = as_of(contigs, edges).where(F.col("nreads") > more_reads_than)
    last = contigs.agg(F.date_trunc(step, F.max("created")).cast("date").alias("last"))  # one row
    unit = F.expr({"day": "interval 1 day", "week": "interval 7 days", "month": "interval 1 month"}[step])
    first = F.date_trunc(step, F.col("created")).cast("date")
    at = at.join(F.broadcast(last)).withColumn("end", F.least("last", F.coalesce("gone", "last")))
    days = F.when(F.col("end") >= first, F.sequence(first, F.col("end"), unit))
    each = at.withColumn("day", F.explode(days)).where((F.col("day") > F.col("created")) & (F.col("gone").isNull() | (F.col("day") < F.col("gone"))))
    return each.drop("last", "end", "gone")


def project_history(contigs: DataFrame, edges: DataFrame, step: str = "month") -> DataFrame:
    """Totals and N50 of every project at every step."""
    each = lived(contigs, edges, step)
    return totals(each, "day", "project_id").join(n50(each, "day", "project_id"), ["day", "project_id"])


def series(contigs: DataFrame, edges: DataFrame) -> DataFrame:
    """Totals of all contigs at the start of every month and week."""
    at = [totals(lived(contigs, edges, step), "day").withColumn("step", F.lit(step)) for step in ("month", "week")]
    return at[0].unionByName(at[1])


def organism_history(contigs: DataFrame, edges: DataFrame, mappings: DataFrame, reads: DataFrame, step: str = "day") -> DataFrame:
    """Per day: reads in contigs, all reads, free reads, dated (asped) and undated (next_gen) ones.

    A read's days in contigs are the union of its contigs' lives; starts and ends of these unions are added up per day, so neither
    days nor reads are crossed.
    """
    life = as_of(contigs, edges).where("nreads > 1").select("contig_id", "created", F.coalesce("gone", F.lit("9999-12-31").cast("date")).alias("gone"))
    spans = mappings.select("contig_id", "seq_id").join(life, "contig_id").select("seq_id", F.date_add("created", 1).alias("a"), F.col("gone").cast("date").alias("b")).where("a < b")
    line = W.partitionBy("seq_id").orderBy("a", "b")
    reach = spans.withColumn("reach", F.max("b").over(line.rowsBetween(W.unboundedPreceding, -1)))
    part = F.sum((F.col("reach").isNull() | (F.col("a") > F.col("reach"))).cast("int")).over(line)
    whole = reach.withColumn("part", part).groupBy("seq_id", "part").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    events = whole.groupBy(F.col("a").alias("day")).agg(F.count("*").alias("n")).unionByName(whole.groupBy(F.col("b").alias("day")).agg((-F.count("*")).alias("n")))
    by_day = events.groupBy("day").agg(F.sum("n").alias("n"))
    bounds = contigs.agg(F.date_trunc(step, F.min("created")).cast("date").alias("a"), F.date_trunc(step, F.max("created")).cast("date").alias("b"))
    unit = F.expr({"day": "interval 1 day", "week": "interval 7 days", "month": "interval 1 month"}[step])
    days = bounds.where("a is not null").select(F.explode(F.sequence("a", "b", unit)).alias("day"), F.lit(0).cast("long").alias("n"), F.lit(True).alias("wanted"))
    # one row a day, however many reads there are
    line = days.unionByName(by_day.withColumn("wanted", F.lit(False))).withColumn("in_contigs", F.sum("n").over(W.orderBy("day").rangeBetween(W.unboundedPreceding, 0)))
    all_of = reads.agg(F.count("*").alias("total"), F.count("asped").alias("asped"))
    return line.where("wanted and in_contigs > 0").join(F.broadcast(all_of)).select(
        "day", "in_contigs", "total", (F.col("total") - F.col("in_contigs")).alias("free_reads"), "asped", (F.col("total") - F.col("asped")).alias("next_gen"))


def history_delta(history: DataFrame, column: str, more_than: int, days: int = 1) -> DataFrame:
    """day, delta: changes of a column since the calendar day before, if larger than a threshold."""
    before = history.select(F.date_add("day", days).alias("day"), F.col(column).alias("old"))
    at = history.join(before, "day").select("day", (F.col(column) - F.col("old")).alias("delta"))
    return at.where(F.abs("delta") > more_than)


MEASURES = {
    "reads": lambda: F.sum("nreads"), "length": lambda: F.sum("length"), "contigs": lambda: F.count("*"), "largest": lambda: F.max("length"),
    "average": lambda: F.max("length") / F.count("*"),  # fixed: the largest contig over their number
}


def inherited_project(edges: DataFrame, contigs: DataFrame, measure: str = "reads") -> DataFrame:
    """contig_id, project_id: the project that leads among the parents by a measure; the lowest id if tied."""
    p = contigs.select(F.col("contig_id").alias("parent_id"), "project_id", "nreads", "length")
    at = edges.join(p, "parent_id").groupBy("contig_id", "project_id").agg(MEASURES[measure]().cast("double").alias("m"))
    return at.groupBy("contig_id").agg(F.max_by("project_id", F.struct("m", -F.col("project_id"))).alias("project_id"))


def read_batches(reads: DataFrame, increment: int) -> DataFrame:
    """asped, n, batch: days in order, a batch ends with the day on which it exceeds ``increment`` reads.

    Reads are counted per day first; only one row a day is scanned in order.
    """
    days = reads.where("asped is not null").groupBy("asped").agg(F.count("*").alias("n"))
    line = days.agg(F.array_sort(F.collect_list(F.struct("asped", "n"))).alias("d"))
    start = F.struct(F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("batch"), F.array().cast("array<struct<asped:date,n:bigint,batch:bigint>>").alias("out"))

    def step(acc, day):
        run = acc["run"] + day["n"]
        full = run > increment
        row = F.struct(day["asped"].cast("date").alias("asped"), day["n"].alias("n"), acc["batch"].alias("batch"))
        return F.struct(F.when(full, 0).otherwise(run).cast("long").alias("run"), (acc["batch"] + full.cast("long")).alias("batch"), F.concat(acc["out"], F.array(row)).alias("out"))

    return line.select(F.explode(F.aggregate("d", start, step, lambda a: a["out"])).alias("r")).select("r.asped", "r.n", "r.batch")


CONTIG_KEYS = ("length", "nreads", "created", "contig_id", "project_id")


def sorted_contigs(contigs: DataFrame, key: str = "length", ascending: bool = False, by_project: bool = False) -> DataFrame:
    """Contigs in order of one of ``CONTIG_KEYS``; ties by id."""
    if key not in CONTIG_KEYS:
        raise ValueError(f"no key {key}")
    order = F.col(key).asc() if ascending else F.col(key).desc()
    return contigs.orderBy(*([F.col("project_id")] if by_project else []), order, "contig_id")


def sorted_projects(projects: DataFrame, contigs: DataFrame, key: str = "contigs", ascending: bool = False) -> DataFrame:
    """Projects with their statistics in order of name, project_id, assembly_id, contigs, nreads, total_length, mean_length, max_length or newest."""
    newest = contigs.groupBy("project_id").agg(F.max("created").alias("newest"))
    at = projects.join(totals(contigs, "project_id").join(newest, "project_id"), "project_id", "left").na.fill(0, ["contigs", "nreads", "total_length", "mean_length", "max_length"])
    return at.orderBy(F.col(key).asc() if ascending else F.col(key).desc(), "name")
