"""Merkle manifest of a dataset: one tree for each source over its rows, and one tree over the sources' roots.

Slot pivot: a level of all trees is one table (tree, idx, node).  Its parents come from one grouping by (tree, idx / 16) whose
conditional aggregates spread the children into 16 slot columns; hashing the concatenated columns gives the parent, and
concatenating all columns but a child's own gives that child's siblings.  Levels are built upward with one shuffle each, every one
a sixteenth of that before; then paths of siblings come down, one join a level of parents with their own parents.  Both
sides of these joins have unique keys, so a source that holds most rows spreads like any other.

Rows get their places by a range partitioning by (source, doc_id, leaf): rows count within their partition, and the number of
rows of the partitions before is added.  No task holds a source, and the driver sees the length of the longest tree alone.

Edge cases: a field that is null counts as ``-``.  A null source is a tree of its own, before the others; rows of one source with a null
doc_id come first.  Rows of equal doc_id stand in the order of their leaves, so equal rows give the same tree in any order.  A lone leaf is its
source's root; a lone source's root is the root; such a path has no siblings.  An empty table gives no rows.  Texts are hashed
whole, whatever their length.  Only the named columns are read, so others cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm.batches import cut, table

FANOUT = 16
SLOTS = [f"c{k}" for k in range(FANOUT)]
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest_of(values: list[Column]) -> Column:
    """SHA-256, as 32 bytes, of values that are told apart by their lengths."""
    each = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.unhex(F.sha2(F.concat(*each).cast("binary"), 256))


def text_of(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def joined_digest(texts: Column) -> Column:
    return F.unhex(F.sha2(texts.cast("binary"), 256))


@dataclass
class Forest:
    """Trees bottom-up.  ``leaves``: tree, width, idx, node.  ``levels``: for each level the parents with their slot columns.
    ``tops``: tree, height, top (the digest that remains)."""

    leaves: DataFrame
    levels: list[DataFrame]
    tops: DataFrame


def numbered(nodes: DataFrame, order: list[str]) -> DataFrame:
    """``nodes`` (tree, node, and the columns of ``order``) as tree, width (nodes of the tree), idx (place in it, from 0), node.

    ``order`` must end in a column that tells equal rows apart, as no other cut could split them.
    """
    dealt = nodes.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    dealt = cut(dealt.select("tree", "node", F.monotonically_increasing_id().alias("at")))
    piece = F.shiftright("at", 33).alias("piece")
    pieces = dealt.groupBy("tree", piece).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    own = Window.partitionBy("tree")
    before = F.coalesce(F.sum("n").over(own.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = pieces.select("tree", "piece", (before - F.col("first")).alias("shift"), F.sum("n").over(own).alias("width"))
    placed = dealt.withColumn("piece", F.shiftright("at", 33)).join(pieces, ["tree", "piece"])
    return placed.select("tree", "width", (F.col("at") + F.col("shift")).alias("idx"), "node")


def grown(nodes: DataFrame, order: list[str]) -> Forest:
    """The trees over ``nodes`` (tree, node with a field ``digest``, and the columns of ``order``)."""
    leaves = cut(numbered(nodes, order))
    most = leaves.agg(F.max("width")).first()[0] or 0
    ended = lambda level, height: level.where("width = 1").select("tree", F.lit(height).alias("height"), F.col("node.digest").alias("top"))
    level, levels, tops = leaves, [], [ended(leaves, 0)]
    while most > 1:
        spread = [F.expr(f"max(node) filter (where idx % {FANOUT} = {k}) as {c}") for k, c in enumerate(SLOTS)]
        levels.append(cut(level.where("width > 1").groupBy("tree", "width", F.expr(f"idx div {FANOUT} as parent")).agg(*spread)))
        whole = joined_digest(F.expr(f"concat_ws('', {', '.join(f'lower(hex({c}.digest))' for c in SLOTS)})"))
        above = F.ceil(F.col("width") / FANOUT).cast("long").alias("width")
        level = levels[-1].select("tree", above, F.col("parent").alias("idx"), F.struct(whole.alias("digest")).alias("node"))
        tops.append(ended(level, len(levels)))
        most = -(-most // FANOUT)
    return Forest(leaves, levels, cut(reduce(DataFrame.unionByName, tops)))


def lowered(forest: Forest, begun: DataFrame) -> DataFrame:
    """node, path and the carried columns of every leaf.

    ``begun`` has a row for each tree: tree, carried columns, and the path of its top.  A path is an array of (left, right), siblings
    before and after, from the lowest level up.
    """
    carried = [c for c in begun.columns if c not in ("tree", "path")]
    begun = begun.join(forest.tops.select("tree", "height"), "tree")
    at = lambda height: begun.where(F.col("height") == height).select("tree", F.lit(0).cast("long").alias("parent"), "path", *carried)
    parents = at(len(forest.levels))
    for height in range(len(forest.levels), 0, -1):
        rows = forest.levels[height - 1].join(parents, ["tree", "parent"])
        rows = rows.selectExpr("*", *(f"lower(hex({c}.digest)) as t{k}" for k, c in enumerate(SLOTS)))
        side = lambda ks: f"concat_ws('', {', '.join(f't{k}' for k in ks)})" if ks else "''"
        own = lambda k, c: f"named_struct('node', {c}, 'left', {side(range(k))}, 'right', {side(range(k + 1, FANOUT))})"
        children = F.expr(f"array({', '.join(own(k, c) for k, c in enumerate(SLOTS))})")  # one text, as hundreds of columns take seconds to build
        rows = rows.select("tree", "parent", "path", *carried, F.posexplode(children).alias("slot", "own")).where("own.node is not null")
        path = F.concat(F.array(F.struct("own.left", "own.right")), F.col("path")).alias("path")
        if height == 1:
            below = rows.select("own.node", path, *carried)
        else:
            lower = rows.select("tree", (F.col("parent") * FANOUT + F.col("slot")).alias("parent"), path, *carried)
            parents = lower.unionByName(at(height - 1))
    lone = forest.leaves.where("width = 1").join(at(0), "tree").select("node", "path", *carried)
    return below.unionByName(lone) if forest.levels else lone


def folded(leaf: Column, path: Column) -> Column:
    """The root, as hex text, that ``leaf`` (hex text) leads to along ``path``."""
    return F.aggregate(path, leaf, lambda below, p: F.sha2(F.concat(p["left"], below, p["right"]).cast("binary"), 256))


def proofs(rows: DataFrame) -> DataFrame:
    """``rows`` (source, doc_id, leaf as 32 bytes, and any further columns) with subroot, root (hex text) and path (siblings
    of the leaf, from the lowest level to the root)."""
    rest = [c for c in rows.columns if c != "leaf"]
    node = F.struct(F.col("leaf").alias("digest"), *rest).alias("node")
    tree = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")).alias("tree")
    nodes = cut(rows.select(tree, node, F.monotonically_increasing_id().alias("tie"))).select("*", "node.doc_id", "node.digest")
    sources = grown(nodes, ["doc_id", "digest", "tie"])
    tops = sources.tops.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.struct(F.col("top").alias("digest"), F.col("tree").alias("name")).alias("node"))
    over = grown(tops, ["name"])
    root = over.tops.select("tree", text_of(F.col("top")).alias("root"), F.array().cast("array<struct<left:string,right:string>>").alias("path"))
    begun = lowered(over, root).select(F.col("node.name").alias("tree"), "path", "root", text_of(F.col("node.digest")).alias("subroot"))
    return lowered(sources, cut(begun)).select(
        *(F.col(f"node.{c}") for c in rest), text_of(F.col("node.digest")).alias("leaf"), "subroot", "root", "path"
    )


def leaf_of(fields: list[str] = FIELDS, **changed: Column) -> Column:
    """The leaf of a row, with some of its fields replaced."""
    return digest_of([changed.get(c, F.col(c)) for c in fields])


def op11_merkle(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    tampered = F.when(chosen, leaf_of(text=F.translate("text", UPPER, LOWER)))
    found = proofs(docs.select("source", "doc_id", leaf_of().alias("leaf"), tampered.alias("tampered")))
    siblings = F.array_join(F.transform("path", lambda p: F.concat(p["left"], p["right"])), "")
    out = found.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(siblings.cast("binary"), 256).alias("proof_sha256"),
        folded(F.coalesce(text_of(F.col("tampered")), "leaf"), F.col("path")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op11_sql(levels: int = 6, over: int = 4) -> str:
    """Trees of at most 16 ** ``levels`` leaves, and of 16 ** ``over`` sources, level by level."""
    field = lambda c: f"coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')"
    leaf = lambda text: "sha256(" + " || ".join(field(c if c != "text" else text) for c in FIELDS) + ")"
    lower = f"translate(text, '{UPPER}', '{LOWER}')"

    def tree(name: str, first: str, n: int) -> list[str]:
        """name_l0..: src, i, h, n (nodes of the level) and name_p0..: src, parent, hs (the children's digests)."""
        out = [f"{name}_l0 as ({first})"]
        for k in range(n):
            out.append(f"{name}_p{k} as (select src, i // 16 as parent, list(h order by i) as hs, max(n) as n from {name}_l{k} group by all)")
            out.append(f"{name}_l{k + 1} as (select src, parent as i, case when n > 1 then sha256(array_to_string(hs, '')) else hs[1] end as h, (n + 15) // 16 as n from {name}_p{k})")
        return out

    def walk(name: str, n: int, start: str, place: str, keys: str) -> list[str]:
        """name_w0..: along the path of every row of ``start``, with siblings so far and the folded digest."""
        out = [f"{name}_w0 as (select *, {place} as i from {start})"]
        for k in range(n):
            own = "(w.i % 16)"
            left, right = f"array_to_string(p.hs[1:{own}], '')", f"array_to_string(p.hs[{own} + 2:], '')"
            out.append(
                f"{name}_w{k + 1} as (select {keys}, w.sibs || case when p.n > 1 then {left} || {right} else '' end as sibs, "
                f"case when p.n > 1 then sha256({left} || w.fold || {right}) else w.fold end as fold, w.i // 16 as i "
                f"from {name}_w{k} w join {name}_p{k} p on p.src is not distinct from w.src and p.parent = w.i // 16)"
            )
        return out

    keys = "w.doc_id, w.leaf, w.source, w.src"
    parts = [
        f"""crc_bytes as (
  select distinct doc_id, flatten(list_transform(str_split(doc_id::varchar, ''), lambda x: [ascii(x)::bigint, -1, -1, -1, -1, -1, -1, -1, -1])) as steps
  from documents where doc_id is not null)""",
        "chosen as (select doc_id, xor(list_reduce(list_prepend(4294967295, steps), lambda c, x: case when x >= 0 then xor(c, x) "
        "else xor(c >> 1, 3988292384 * (c & 1)) end), 4294967295) % 5 = 0 as yes from crc_bytes)",
        f"""leaves as (
  select doc_id, source, {leaf('text')} as leaf, case when yes then {leaf(lower)} else {leaf('text')} end as fold,
         row_number() over (partition by source order by doc_id nulls first, {leaf('text')}) - 1 as i, count(*) over (partition by source) as n
  from documents d left join (select doc_id as chosen_id, yes from chosen) c on c.chosen_id = d.doc_id)""",
        *tree("d", "select source as src, i, leaf as h, n from leaves", levels),
        f"tops as (select src, h, row_number() over (order by src is not null, encode(src)) - 1 as i, count(*) over () as n from d_l{levels})",
        *tree("s", "select 0 as src, i, h, n from tops", over),
        *walk("d", levels, "(select doc_id, leaf, source, source as src, '' as sibs, fold, i as place from leaves)", "place", keys),
        f"middle as (select w.doc_id, w.leaf, w.source, 0 as src, w.sibs, w.fold, t.i as place, t.h as subroot from d_w{levels} w join tops t on t.src is not distinct from w.source)",
        *walk("s", over, "middle", "place", keys + ", w.subroot"),
    ]
    return f"""
with {', '.join(parts)}
select doc_id, leaf, subroot, r.h as root, sha256(sibs) as proof_sha256, fold as folded_root, fold = r.h as verified
from s_w{over} join s_l{over} r on true
"""
