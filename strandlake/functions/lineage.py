"""Lineage of contigs: (contig_id, parent_id) edges, their closure by doubling, links through shared reads, import and removal.

Edges with a null end take no part.  A cycle is an error, which ``relations`` and ``ages`` report as soon as they meet it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.functions.sequences import reverse_complement
from strandlake.operators.components import kept, settled


def relations(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """contig_id, relative (any ancestor), gen_min, gen_max (shortest and longest path).

    Round k extends all paths of up to 2^k steps by those of exactly 2^k, so a chain of a thousand generations takes ten joins and a pair in it
    is met once, not once for each contig between.
    """
    one = edges.select("contig_id", F.col("parent_id").alias("relative")).na.drop().distinct()
    exact = settled(one)
    known = exact.withColumn("gen_min", F.lit(1)).withColumn("gen_max", F.lit(1))
    for k in range(rounds):
        if exact.isEmpty():
            return known
        if not known.where("contig_id = relative").isEmpty():
            raise ValueError("the lineage has a cycle")
        far = exact.select(F.col("contig_id").alias("relative"), F.col("relative").alias("r"))
        longer = known.join(far, "relative").select("contig_id", F.col("r").alias("relative"), (F.col("gen_min") + 2**k).alias("gen_min"), (F.col("gen_max") + 2**k).alias("gen_max"))
        known = settled(known.unionByName(longer).groupBy("contig_id", "relative").agg(F.min("gen_min").alias("gen_min"), F.max("gen_max").alias("gen_max")))
        exact = settled(exact.join(far, "relative").select("contig_id", F.col("r").alias("relative")).distinct())
    raise ValueError("the lineage has a cycle")


def both_ways(closure: DataFrame) -> DataFrame:
    """Ancestors with generations from 1 up, descendants from -1 down."""
    down = closure.select(F.col("relative").alias("contig_id"), F.col("contig_id").alias("relative"), (-F.col("gen_max")).alias("gen_min"), (-F.col("gen_min")).alias("gen_max"))
    return closure.select(down.columns).unionByName(down)


def ages(current: DataFrame, edges: DataFrame) -> DataFrame:
    """contig_id, age: the longest path from a current contig; 0 for current contigs.

    Runs of contigs with one child and one parent are contracted by doubling, so that a long chain takes few rounds.  What is left is peeled in layers
    from the young end: a contig is due when all its children are done, and is older than the oldest of them by the steps between.  Every edge is used once, and the rows
    held stay in proportion to the edges.  A cycle is an error, found as soon as no contig is due.
    """
    own = kept(current.select("contig_id").distinct())
    links, inner = contracted(kept(edges.select("contig_id", "parent_id").na.drop().distinct()), own)
    known = own.select("contig_id", F.lit(0).cast("long").alias("age"))
    young = links.select("contig_id").distinct().join(own, "contig_id", "full").join(links.select(F.col("parent_id").alias("contig_id")), "contig_id", "left_anti")
    ready = kept(young.join(known, "contig_id", "left"))
    left, waiting, done = links, kept(known.join(ready.select("contig_id"), "contig_id", "left_anti")), ready
    while not left.isEmpty():
        if ready.isEmpty():
            raise ValueError("the lineage has a cycle")
        given = left.join(ready, "contig_id").groupBy("parent_id").agg(F.max(F.col("age") + F.col("steps")).alias("given"))
        given = given.withColumnRenamed("parent_id", "contig_id")
        waiting = kept(waiting.join(given, "contig_id", "full").select("contig_id", F.greatest("age", "given").alias("age")))
        left = kept(left.join(ready.select("contig_id"), "contig_id", "left_anti"))
        open_ = left.select(F.col("parent_id").alias("contig_id"))
        ready, waiting = kept(waiting.join(open_, "contig_id", "left_anti")), waiting.join(open_, "contig_id", "left_semi")
        done = done.unionByName(ready)
    within = inner.join(done.withColumnRenamed("contig_id", "head"), "head").select("contig_id", (F.col("age") + F.col("steps")).alias("age"))
    return done.unionByName(within).where("age is not null")


def contracted(edges: DataFrame, own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """contig_id, parent_id, steps: the edges with runs of inner contigs (one child, one parent, not in ``own``) as one edge each; and
    (contig_id, head, steps) of the inner contigs: the contig at the young end of their run, and how far it is."""
    single = lambda key, name: edges.groupBy(key).agg(F.count("*").alias("n")).where("n = 1").select(F.col(key).alias(name))
    inner = kept(single("parent_id", "node").join(single("contig_id", "node"), "node").join(own.withColumnRenamed("contig_id", "node"), "node", "left_anti"))
    below = inner.select(F.col("node").alias("head"), F.lit(True).alias("open"))
    at = edges.join(inner.withColumnRenamed("node", "parent_id"), "parent_id").select(F.col("parent_id").alias("contig_id"), F.col("contig_id").alias("head"), F.lit(1).cast("long").alias("steps"))
    at = kept(at.join(below, "head", "left").withColumn("open", F.coalesce("open", F.lit(False))))
    rounds = at.count().bit_length() + 1
    while not at.where("open").isEmpty():
        if not rounds:
            raise ValueError("the lineage has a cycle")
        rounds -= 1
        far = at.select(F.col("contig_id").alias("head"), F.col("head").alias("h"), F.col("steps").alias("s"), F.col("open").alias("o"))
        moved = at.where("open").join(far, "head").select("contig_id", F.col("h").alias("head"), (F.col("steps") + F.col("s")).alias("steps"), F.col("o").alias("open"))
        at = kept(at.where("not open").unionByName(moved.select("contig_id", "head", "steps", "open").select(at.columns)))
    inner = at.select("contig_id", "head", "steps")
    outer = edges.join(at.select(F.col("contig_id").alias("parent_id")), "parent_id", "left_anti")
    links = outer.join(inner, "contig_id", "left").select(F.coalesce("head", "contig_id").alias("contig_id"), "parent_id", (F.coalesce("steps", F.lit(0)) + 1).alias("steps"))
    return kept(links), inner


def at_age(current: DataFrame, edges: DataFrame, age: int) -> DataFrame:
    return ages(current, edges).where(F.col("age") == age).select("contig_id")


def shared_reads(mappings: DataFrame, pairs: DataFrame) -> DataFrame:
    """contig_id, parent_id, seq_id, dir, shift, cstart, cfinish: one row per read that a child and its parent share."""
    p = mappings.select(F.col("contig_id").alias("parent_id"), "seq_id", F.col("direction").alias("pdir"), F.col("cstart").alias("pstart"), F.col("cfinish").alias("pfinish"))
    both = mappings.join(pairs.select("contig_id", "parent_id"), "contig_id").join(p, ["parent_id", "seq_id"])
    same = F.col("direction") == F.col("pdir")
    return both.select("contig_id", "parent_id", "seq_id", F.when(same, 1).otherwise(-1).alias("dir"),
                       F.when(same, F.col("cstart") - F.col("pstart")).otherwise(F.col("cstart") + F.col("pfinish")).alias("shift"), "cstart", "cfinish")


LINK = ["contig_id", "parent_id"]


def link_contigs(
    mappings: DataFrame, pairs: DataFrame, drift: int | None = None, least_reads: int | None = None,
    window: int | None = None, correlation: float = 0.75, defects: int = 5, prune: bool = False,
) -> DataFrame:
    """contig_id, parent_id, dir, shift, part, nreads, cstart, cfinish: the segments of each link.

    Reads of the direction with fewer bases are left out (forward wins a tie).  With ``drift``, shifts farther than that from the
    median, weighted by bases, are left out.  Reads of one shift whose ranges meet make a segment; segments of fewer reads
    than ``least_reads`` (by default 1 + int(ln n) for n shared reads) go.

    With ``window``, links whose shifts spread over at least that are tested (see ``unruly``): those that fail keep shifts within half of it
    of the median, and segments of two bases or more; what they lose marks a range of the contig, and segments inside that range go too, but for the first.
    With ``prune``, segments inside others go (of equal ones the lowest shift stays), and neighbours that overlap share the overlap out.
    """
    shared = shared_reads(mappings, pairs).withColumn("bases", F.col("cfinish") - F.col("cstart") + 1)
    sides = shared.groupBy(*LINK, "dir").agg(F.sum("bases").alias("bases"))
    main = sides.groupBy(*LINK).agg(F.max_by("dir", F.struct("bases", "dir")).alias("dir"))
    at = shared.join(main, [*LINK, "dir"])
    if drift is not None:
        at = at.join(middle_shifts(at), LINK).where(F.abs(F.col("shift") - F.col("middle")) <= drift).drop("middle")
    found = islands(at)
    least = F.lit(least_reads) if least_reads is not None else 1 + F.floor(F.log(F.sum("nreads").over(W.partitionBy(*LINK)).cast("double"))).cast("int")
    found = found.withColumn("least", least).where("nreads >= least").drop("least")
    if window is not None:
        found = masked(found, unruly(at, window, correlation, defects), window)
    return pruned_links(found) if prune else found


def middle_shifts(at: DataFrame) -> DataFrame:
    """The median shift of each link, weighted by bases: the first at which half of all are reached."""
    by_shift = at.groupBy(*LINK, "shift").agg(F.sum("bases").alias("b"))
    run = by_shift.withColumn("run", F.sum("b").over(W.partitionBy(*LINK).orderBy("shift"))).withColumn("all", F.sum("b").over(W.partitionBy(*LINK)))
    return run.where("run * 2 >= all").groupBy(*LINK).agg(F.min("shift").alias("middle"))


def islands(at: DataFrame) -> DataFrame:
    """Reads of one shift whose ranges meet, as one segment each."""
    line = W.partitionBy(*LINK, "shift").orderBy("cstart", "seq_id")
    reach = F.max("cfinish").over(line.rowsBetween(W.unboundedPreceding, -1))
    part = F.sum((F.col("reach").isNull() | (F.col("cstart") > F.col("reach"))).cast("int")).over(line)
    parts = at.withColumn("reach", reach).withColumn("part", part).groupBy(*LINK, "dir", "shift", "part")
    return parts.agg(F.count("*").alias("nreads"), F.min("cstart").alias("cstart"), F.max("cfinish").alias("cfinish"))


def unruly(at: DataFrame, window: int = 40, correlation: float = 0.75, defects: int = 5) -> DataFrame:
    """contig_id, parent_id, middle: links whose shifts spread over ``window`` or more, hardly follow the position, and turn back more than ``defects`` times.

    Islands of each shift give positions (their middles); where a shift has several, those of at most 5 bases (or half of the
    largest, if that has at most 5) don't count.  The correlation is that of raw products of shift and position.  A turn is a change of direction of the
    mean positions, in order of shifts; a further island of a shift counts as one.
    """
    own = W.partitionBy(*LINK, "shift")
    size = F.col("cfinish") - F.col("cstart") + 1
    some = islands(at).withColumn("size", size).withColumn("largest", F.max("size").over(own)).withColumn("many", F.count("*").over(own))
    some = some.where((F.col("many") == 1) | (F.col("size") > F.when(F.col("largest") <= 5, F.col("largest") / 2).otherwise(5)))
    place, shift = (F.col("cstart") + F.col("cfinish")) / 2, F.col("shift").cast("double")
    each = some.groupBy(*LINK, "shift").agg(
        F.count("*").alias("n"), F.avg(place).alias("place"), F.sum(place * place).alias("pp"), F.sum(place * shift).alias("ps"), F.sum(shift * shift).alias("ss")
    )
    line = W.partitionBy(*LINK).orderBy("shift")
    step = F.col("place") - F.lag("place").over(line)
    each = each.withColumn("step", step).withColumn("turn", F.coalesce((F.col("step") * F.lag("step").over(line) < 0).cast("int"), F.lit(0)))
    found = each.groupBy(*LINK).agg(
        (F.sum("ps") / F.sqrt(F.sum("pp") * F.sum("ss"))).alias("r"), F.sum(F.col("n") - 1 + F.col("turn")).alias("turns"), (F.max("shift") - F.min("shift")).alias("spread")
    )
    bad = found.where((F.col("spread") >= window) & (F.abs("r") < correlation) & (F.col("turns") > defects)).select(*LINK)
    return middle_shifts(at).join(bad, LINK, "left_semi")


def masked(segments: DataFrame, middles: DataFrame, window: int) -> DataFrame:
    at = segments.join(middles, LINK, "left").withColumn("far", F.coalesce(F.abs(F.col("shift") - F.col("middle")) * 2 > window, F.lit(False)))
    at = at.where((F.col("middle").isNull()) | (F.col("cfinish") > F.col("cstart")))
    bad = at.where("far").groupBy(*LINK).agg(F.min("cstart").alias("bad_start"), F.max("cfinish").alias("bad_finish"))
    first = F.row_number().over(W.partitionBy(*LINK).orderBy("cstart", F.col("cfinish").desc(), "shift")) == 1
    at = at.where("not far").join(bad, LINK, "left").withColumn("first", first)
    inside = F.coalesce((F.col("cstart") >= F.col("bad_start")) & (F.col("cfinish") <= F.col("bad_finish")), F.lit(False))
    return at.where(F.col("first") | ~inside).select(segments.columns)


def pruned_links(segments: DataFrame) -> DataFrame:
    """Segments without those inside others of their link, cut back where neighbours overlap, each by half, rounded up."""
    line = W.partitionBy(*LINK).orderBy("cstart", F.col("cfinish").desc(), "shift", "part")
    reach = F.max("cfinish").over(line.rowsBetween(W.unboundedPreceding, -1))
    out = segments.withColumn("reach", reach).where("reach is null or cfinish > reach").drop("reach")
    over = F.greatest(F.coalesce(F.col("cfinish") - F.lead("cstart").over(line) + 1, F.lit(0)), F.lit(0))
    out = out.withColumn("give", F.floor((over + 1) / 2))
    cut = out.withColumns({"cstart": F.col("cstart") + F.coalesce(F.lag("give").over(line), F.lit(0)), "cfinish": F.col("cfinish") - F.col("give")})
    return cut.where("cstart <= cfinish").select(segments.columns)


def valid_links(links: DataFrame, contigs: DataFrame, spurious: float = 1.0, split: float = 1.0) -> DataFrame:
    """``links`` (contig_id, parent_id, shared, overlap) with ``verdict``: 1 regular, 2 split parent, 0 probably spurious.

    All reads of either contig make a link regular.  Otherwise it needs sqrt(n - 0.4) + 0.1 of the parent's n reads (1 if n <= 2), and
    a parent of such a low threshold half its length too; a parent that keeps more reads than the threshold elsewhere is split.
    """
    size = contigs.select("contig_id", F.col("nreads").alias("child_reads"))
    parent = contigs.select(F.col("contig_id").alias("parent_id"), F.col("nreads").alias("parent_reads"), F.col("length").alias("parent_length"))
    at = links.join(size, "contig_id").join(parent, "parent_id")
    base = F.when(F.col("parent_reads") <= 2, 1.0).otherwise((F.sqrt(F.greatest(F.col("parent_reads") - 0.4, F.lit(0.0))) + 0.1) * spurious)
    verdict = (
        F.when((F.col("shared") == F.col("parent_reads")) | (F.col("shared") == F.col("child_reads")), 1).when(F.col("shared") < base, 0)
        .when((base <= 1) & (F.col("overlap") * 2 < F.greatest(F.col("parent_length"), F.lit(1))), 0)
        .when(F.col("shared") < F.col("parent_reads") - base * split, 2).otherwise(1)
    )
    return at.select(*links.columns, verdict.alias("verdict"))


def repaired(stored: DataFrame, computed: DataFrame) -> DataFrame:
    """contig_id, parent_id, state: confirmed, missing (computed only) or invalid (stored only)."""
    one, two = stored.select("contig_id", "parent_id", F.lit(1).alias("s")).distinct(), computed.select("contig_id", "parent_id", F.lit(1).alias("c")).distinct()
    state = F.when(F.col("s").isNull(), "missing").when(F.col("c").isNull(), "invalid").otherwise("confirmed")
    return one.join(two, ["contig_id", "parent_id"], "full_outer").select("contig_id", "parent_id", state.alias("state"))


def found_parents(mappings: DataFrame, contigs: DataFrame, edges: DataFrame) -> DataFrame:
    """child, parent: older contigs that share reads with a contig, but those with a child among the same candidates."""
    at = contigs.select("contig_id", "created")
    one = mappings.select(F.col("contig_id").alias("child"), "seq_id").join(at.select(F.col("contig_id").alias("child"), F.col("created").alias("c1")), "child")
    two = mappings.select(F.col("contig_id").alias("parent"), "seq_id").join(at.select(F.col("contig_id").alias("parent"), F.col("created").alias("c2")), "parent")
    pairs = one.join(two, "seq_id").where("c2 < c1 and parent <> child").select("child", "parent").distinct()
    younger = pairs.join(edges.select(F.col("contig_id").alias("parent"), F.col("parent_id").alias("gone")), "parent").select("child", F.col("gone").alias("parent"))
    return pairs.join(younger, ["child", "parent"], "left_anti")


def contig_checksums(mappings: DataFrame) -> DataFrame:
    return mappings.groupBy("contig_id").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list("seq_id")), lambda s: s.cast("string")), ",")).alias("checksum"))


def content_checksums(sequences: DataFrame) -> DataFrame:
    """seq_id, dna_md5, reverse_md5, quality_md5, quality_reverse_md5 of ``sequences`` (seq_id, dna, quality).

    The reverse is the complement of the DNA read from its end; qualities are joined by commas.  What is null has no digest.
    """
    text = lambda q: F.md5(F.array_join(q, ","))
    return sequences.select("seq_id", F.md5("dna").alias("dna_md5"), F.md5(reverse_complement("dna")).alias("reverse_md5"),
                            text(F.col("quality")).alias("quality_md5"), text(F.reverse("quality")).alias("quality_reverse_md5"))


def already_stored(new: DataFrame, stored: DataFrame) -> DataFrame:
    """contig_id (new), same_as: incoming contigs whose reads and mappings equal those of a stored one, up to a shift.

    ``new`` and ``stored``: contig_id, seq_id, direction, cstart, cfinish.
    """
    def shape(df: DataFrame, name: str) -> DataFrame:
        shifted = df.withColumn("zero", F.min("cstart").over(W.partitionBy("contig_id")))
        row = F.struct("seq_id", "direction", (F.col("cstart") - F.col("zero")).alias("a"), (F.col("cfinish") - F.col("zero")).alias("b"))
        return shifted.groupBy(F.col("contig_id").alias(name)).agg(F.md5(F.to_json(F.array_sort(F.collect_list(row)))).alias("shape"))

    return shape(new, "contig_id").join(shape(stored, "other"), "shape").groupBy("contig_id").agg(F.min("other").alias("same_as"))


def load(new: DataFrame, stored: DataFrame, stored_contigs: DataFrame, edges: DataFrame, project: int) -> DataFrame:
    """A batch import: contig_id, outcome (loaded, empty or duplicate), same_as, nreads, length, checksum, parents, project_id.

    ``new`` and ``stored`` are mappings.  Contigs equal to a stored one are not loaded.  Parents are the current stored contigs that share
    reads; the project is that of the parent with the most shared reads (lowest id if tied), else ``project``.
    """
    size = new.groupBy("contig_id").agg(F.count("*").alias("nreads"), (F.max("cfinish") - F.min("cstart") + 1).alias("length"))
    current = stored_contigs.join(edges.select(F.col("parent_id").alias("contig_id")), "contig_id", "left_anti").select(F.col("contig_id").alias("parent_id"), "project_id")
    held = stored.select(F.col("contig_id").alias("parent_id"), "seq_id").join(current, "parent_id")
    shared = new.select("contig_id", "seq_id").join(held, "seq_id").groupBy("contig_id", "parent_id", "project_id").agg(F.count("*").alias("n"))
    parents = shared.groupBy("contig_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("parent_id")), lambda p: p.cast("string")), ",").alias("parents"),
        F.max_by("project_id", F.struct("n", -F.col("parent_id"))).alias("inherited"),
    )
    at = size.join(contig_checksums(new), "contig_id").join(already_stored(new, stored), "contig_id", "left").join(parents, "contig_id", "left")
    outcome = F.when(F.col("same_as").isNotNull(), "duplicate").otherwise("loaded")
    return at.select("contig_id", outcome.alias("outcome"), "same_as", "nreads", "length", "checksum", F.coalesce("parents", F.lit("")).alias("parents"),
                     F.coalesce("inherited", F.lit(project)).cast("long").alias("project_id"))


def doomed(contigs: DataFrame, edges: DataFrame, rule: str, **options) -> DataFrame:
    """contig_id of the contigs that a rule removes: singleton, orphaned, after (date=), project (project_id=), retired or short (length=)."""
    if rule == "retired":
        return edges.where("contig_id = 0").select(F.col("parent_id").alias("contig_id")).distinct()
    tests = {
        "singleton": lambda: F.col("nreads") == 1, "orphaned": lambda: F.col("nreads") == 0, "after": lambda: F.col("created") > F.lit(options["date"]).cast("date"),
        "project": lambda: F.col("project_id") == options["project_id"], "short": lambda: F.col("length") < options["length"],
    }
    found = contigs.where(tests[rule]()).select("contig_id")
    # a contig that has a child is history and stays, but where everything of a date or project goes
    return found if rule in ("after", "project") else found.join(edges.select(F.col("parent_id").alias("contig_id")), "contig_id", "left_anti")


def pruned(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows that belong to the contigs in ``gone``, as contig_id or parent_id."""
    out = {}
    for name, rows in tables.items():
        for key in {"contig_id", "parent_id"} & set(rows.columns):
            rows = rows.join(gone.select(F.col("contig_id").alias(key)), key, "left_anti")
        out[name] = rows
    return out


def assigned(moves: DataFrame, contigs: DataFrame, current: DataFrame, projects: DataFrame) -> DataFrame:
    """contig_id, project_id, outcome of bulk moves (contig_id, new_project_id); a move that can't be made keeps the project."""
    p = projects.select(F.col("project_id").alias("to"))
    at = moves.join(contigs.select("contig_id", F.col("project_id").alias("old")), "contig_id", "left").join(p, F.col("new_project_id") == F.col("to"), "left")
    at = at.join(current.select(F.col("contig_id").alias("cur")), F.col("contig_id") == F.col("cur"), "left")
    outcome = F.when(F.col("old").isNull(), "unknown contig").when(F.col("to").isNull(), "unknown project").when(F.col("cur").isNull(), "not current").otherwise("moved")
    return at.select("contig_id", F.when(outcome == "moved", F.col("to")).otherwise(F.col("old")).alias("project_id"), outcome.alias("outcome"))


def audit_rows(moves: DataFrame, contigs: DataFrame, current: DataFrame, projects: DataFrame) -> DataFrame:
    """contig_id, from_project, to_project and the further columns of ``moves`` (who, when ...): a row for each move that is made and changes something."""
    more = [c for c in moves.columns if c not in ("contig_id", "new_project_id")]
    done = assigned(moves.select("contig_id", "new_project_id").distinct(), contigs, current, projects).where("outcome = 'moved'")
    done = done.join(contigs.select("contig_id", F.col("project_id").alias("from_project")), "contig_id").where("from_project <> project_id")
    made = done.select("contig_id", F.col("project_id").alias("new_project_id"), "from_project")
    return moves.join(made, ["contig_id", "new_project_id"]).select("contig_id", "from_project", F.col("new_project_id").alias("to_project"), *more)
