"""N-gram Jaccard join with Bayesian pruning of candidates, and groups of near copies.

Texts are sets of shingles of five consecutive folded words (a shorter text, but not an empty one, is one shingle).
Two texts are linked if their sets have a Jaccard similarity of ``threshold`` or more.

1. Every text becomes a digest of its set, 128 MinHash values (of which one byte each is kept) and 32 bands of four
   values.  Texts of equal sets are one class; all that follows is between classes.  A pair at 0.8 shares no band
   with a probability of 5e-8.
2. Classes that share a band are candidates.  Classes whose bands lead to the same largest band, over one band
   between them at most, are a neighbourhood.  It is dealt to blocks of about ``block`` classes, but to ``parts``
   blocks at most unless they would exceed ``most`` classes or ``shingles`` shingles; blocks that meet in a band are compared,
   each pair of blocks by one task and once.  So a class travels to ``parts`` + 1 tasks of its neighbourhood at most, however large
   that is, and no group is gathered whole.  MinHash bytes are compared 16 at a time; after each step a pair is
   dropped if the posterior probability of its similarity reaching the threshold (from a uniform prior) is below
   ``tolerance``.
3. The remaining pairs are packed by pairs of blocks; each gets the shingle sets of its classes once
   and counts the shared shingles exactly, one pack of pairs at a time.  It returns a row per class: its links and a tree of its
   block, not the pairs.
4. Groups are the connected components of the trees, by alternating stars with checkpoints in between.

Edge cases: null texts and texts without words have no shingles; such a document is a group of its own without
links.  Rows of equal texts are links of each other.  Repeated ids are rows like others; ``class_id`` is the least
id of the group (null if all its ids are null).  Texts of any length are compared whole; one that alone has more than ``shingles``
shingles has a block with few others.  An empty table gives no rows.  Further columns take no part.  Results do not depend on the
order or partitions of the rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.llm.batches import cut, folded_words, map_rows, table, utf8

SHINGLE, HASHES, BANDS, STEP = 5, 128, 32, 16
THRESHOLD = Fraction(4, 5)


def shingles(data: bytes | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text."""
    words = folded_words(data)
    if not words:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = max(1, len(words) - SHINGLE + 1)
    code = np.full(n, len(words) if len(words) < SHINGLE else SHINGLE, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(min(SHINGLE, len(words))):
            code = code * np.uint64(0x9E3779B97F4A7C15) + each[k : k + n]
            code ^= code >> np.uint64(29)
        code *= np.uint64(0xBF58476D1CE4E5B9)
        code ^= code >> np.uint64(32)
    return np.unique(code)


def hash_functions() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.RandomState(20)
    draw = lambda: rng.randint(0, 2**63 - 1, HASHES, dtype=np.int64).astype(np.uint64)
    return draw() * np.uint64(2) + np.uint64(1), draw()


def min_hashes(found: np.ndarray, a: np.ndarray, b: np.ndarray, most: int = 2048) -> np.ndarray:
    """The least value of each hash function over a set."""
    out = np.full(HASHES, 2**32 - 1, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(found), most):
            out = np.minimum(out, ((found[at : at + most] * a[:, None] + b[:, None]) >> np.uint64(32)).min(1))
    return out.astype(np.uint32)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, set_key (digest of the set), size, sig (HASHES bytes) and bands (BANDS four-byte words)."""

    def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        a, b = hash_functions()
        mix = np.array([3, 5, 7, 11], np.uint32) * np.uint32(0x9E3779B1)
        keys, sizes, sigs, bands = [], [], [], []
        for text in utf8(batch.column("text")):
            found = shingles(text)
            sizes.append(len(found))
            if len(found):
                least = min_hashes(found, a, b)
                with np.errstate(over="ignore"):
                    band = (least.reshape(BANDS, -1) * mix).astype(np.uint32)
                    band = band ^ (band >> np.uint32(15))
                    band = (band * np.array([0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], np.uint32)).sum(1, dtype=np.uint32)
                keys.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                sigs.append((least & np.uint32(255)).astype(np.uint8).tobytes())
                bands.append(band.tobytes())
            else:
                keys.append(None), sigs.append(None), bands.append(None)
        kinds = [pa.binary(), pa.int32(), pa.binary(), pa.binary()]
        return {n: pa.array(v, k) for n, v, k in zip(("set_key", "size", "sig", "bands"), (keys, sizes, sigs, bands), kinds, strict=True)}

    fields = [("set_key", T.BinaryType()), ("size", T.IntegerType()), ("sig", T.BinaryType()), ("bands", T.BinaryType())]
    return map_rows(docs, work, fields, [c for c in docs.columns if c != "text"])


def least_matches(threshold: Fraction, tolerance: float) -> list[int]:
    """Matches that a pair needs after each step to stay.

    With m of n bytes equal and a uniform prior, the posterior of the rate of equal bytes is Beta(m + 1, n - m + 1),
    and the chance that it reaches r is that of at most m successes in n + 1 trials at r.
    """
    r = float(threshold) + (1 - float(threshold)) / 256  # bytes are also equal by chance
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        chance, m = 0.0, -1
        while chance < tolerance:
            m += 1
            chance += comb(n + 1, m) * r**m * (1 - r) ** (n + 1 - m)
        out.append(m)
    return out


def groups_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Whole runs of rows with equal keys, as many at a time as a batch completes."""
    held = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        now = now if held is None else pa.concat_tables([held, now])
        last = now.num_rows - 1
        if last < 0:
            continue
        same = np.ones(now.num_rows, bool)
        for k in keys:
            column = now.column(k).to_numpy()
            same &= column == column[last]
        at = last + 1 - int(np.argmin(same[::-1])) if not same.all() else 0
        held = now.slice(at)
        if at:
            yield now.slice(0, at)
    if held is not None and held.num_rows:
        yield held


def split(rows: pa.Table, keys: list[str]) -> Iterator[pa.Table]:
    """The runs of rows with equal keys, one by one."""
    fresh = np.zeros(rows.num_rows, bool)
    fresh[0] = True
    for k in keys:
        column = rows.column(k).to_numpy()
        fresh[1:] |= column[1:] != column[:-1]
    begin = np.flatnonzero(fresh)
    for a, b in zip(begin, np.append(begin[1:], rows.num_rows), strict=True):
        yield rows.slice(a, b - a)


def fixed(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    """A binary column of equal lengths as a matrix."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), kind).reshape(len(values), -1)


HOME = ["one_home", "two_home"]


def prune(rows: pa.Table, needed: list[int], threshold: Fraction, slab: int = 50_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Surviving pairs of one pair of blocks, as positions in ``rows``, from about ``slab`` compared pairs at a time."""
    sig, bands = fixed(rows.column("sig"), np.uint8), fixed(rows.column("bands"), np.uint32)
    size, home = rows.column("size").to_numpy(), rows.column("home").to_numpy()
    here = home == rows.column("one_home")[0].as_py()
    alone = bool(here.all())
    first, second = np.flatnonzero(here), np.flatnonzero(here if alone else ~here)
    width = max(1, slab // max(1, len(second)))
    for at in range(0, len(first), width):
        i, j = (v.ravel() for v in np.meshgrid(first[at : at + width], second, indexing="ij"))
        fits = np.minimum(size[i], size[j]) * threshold.denominator >= np.maximum(size[i], size[j]) * threshold.numerator
        if alone:
            fits &= i < j
        i, j = i[fits], j[fits]
        shared = (bands[i] == bands[j]).any(1)
        i, j = i[shared], j[shared]
        matches = np.zeros(len(i), np.int64)
        for step, least in zip(range(0, HASHES, STEP), needed, strict=True):
            matches += (sig[i, step : step + STEP] == sig[j, step : step + STEP]).sum(1)
            stay = matches >= least
            i, j, matches = i[stay], j[stay], matches[stay]
        if len(i):
            yield i, j


def homes_of(rows: DataFrame, block: int, parts: int, most: int, most_shingles: int) -> DataFrame:
    """set_key, home for every class of ``rows`` (set_key, size, bucket, many: the bands that several classes share)."""
    largest = lambda df, key: df.groupBy(key).agg(F.max("m").alias("m"))
    own = largest(rows.select("set_key", F.struct("many", "bucket").alias("m")), "set_key")
    next_to = largest(rows.select("set_key", "bucket").join(own, "set_key"), "bucket")
    led = rows.select("set_key", "bucket", "size").join(next_to, "bucket").groupBy("set_key").agg(F.max("m").alias("m"), F.max("size").alias("size"))
    led = led.select("set_key", "size", F.col("m.bucket").alias("lead"))
    n = led.groupBy("lead").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    least = F.greatest(F.ceil(F.col("n") / most), F.ceil(F.col("size") / most_shingles))
    count = F.greatest(F.least(F.ceil(F.col("n") / block), F.lit(parts)), least)
    return led.select("lead", "set_key").join(n, "lead").select("set_key", F.xxhash64("lead", F.pmod(F.xxhash64("set_key"), count)).alias("home"))


def candidates(classes: DataFrame, tolerance: float, threshold: Fraction, **blocks: int) -> DataFrame:
    """one_home, two_home, keys, left, right: pairs that survive the pruning, packed by pair of blocks.

    left and right are positions in the pair of blocks; the row with keys has the positions of these in left.
    """
    place = F.expr(f"explode(sequence(0, {BANDS - 1}))")
    rows = classes.select("set_key", "size", "bands", place.alias("band")).select(
        "set_key", "size", F.xxhash64("band", F.substring("bands", F.col("band") * 4 + 1, F.lit(4))).alias("bucket")
    )
    shared = rows.groupBy("bucket").agg(F.count("*").alias("many")).where("many > 1")
    rows = cut(rows.join(shared, "bucket"))
    homes = cut(homes_of(rows, **blocks))
    meet = rows.select("set_key", "bucket").join(homes, "set_key").select("bucket", "home").distinct()
    other = meet.withColumnRenamed("home", "two_home")
    pairs = meet.withColumnRenamed("home", "one_home").join(other, "bucket").where("one_home <= two_home").select(*HOME).distinct()
    sides = [pairs.join(homes, pairs["one_home"] == homes["home"]), pairs.where("one_home < two_home").join(homes, pairs["two_home"] == homes["home"])]
    ready = sides[0].unionByName(sides[1]).join(classes.select("set_key", "size", "sig", "bands"), "set_key")
    needed = least_matches(threshold, tolerance)

    def run(batches: Iterator[pa.RecordBatch], pack: int = 250_000) -> Iterator[pa.RecordBatch]:
        for whole in groups_of(batches, HOME):
            for part in split(whole, HOME):
                first = [pa.array([part.column(c)[0].as_py()], pa.int64()) for c in HOME]

                def row(keys: list[bytes] | None, left: np.ndarray, right: np.ndarray | None) -> pa.RecordBatch:
                    packed = [None if v is None else v.astype(np.int32).tobytes() for v in (left, right)]
                    rest = [pa.array([keys], pa.list_(pa.binary())), *(pa.array([v], pa.binary()) for v in packed)]
                    return pa.RecordBatch.from_arrays(first + rest, names=[*HOME, "keys", "left", "right"])

                used, held = np.zeros(part.num_rows, bool), []
                for i, j in prune(part, needed, threshold):
                    used[i] = used[j] = True
                    held.append(np.stack([i, j]))
                    if sum(v.shape[1] for v in held) >= pack:
                        yield row(None, *np.concatenate(held, 1))
                        held = []
                if held:
                    yield row(None, *np.concatenate(held, 1))
                if used.any():
                    at = np.flatnonzero(used)
                    yield row(part.column("set_key").take(pa.array(at)).to_pylist(), at, None)

    schema = "one_home long, two_home long, keys array<binary>, left binary, right binary"
    return ready.repartition(*HOME).sortWithinPartitions(*HOME, "set_key").mapInArrow(run, schema)


class Block:
    """The shingle sets of one pair of blocks, and what its verified pairs add up to."""

    def __init__(self, rows: list[tuple[bytes, int, np.ndarray]], names: list[bytes], places: np.ndarray) -> None:
        rows.sort(key=lambda r: r[0])
        self.keys = [k for k, _, _ in rows]
        number = {k: i for i, k in enumerate(self.keys)}
        self.at_place = np.zeros(int(places.max()) + 1, np.int32)
        self.at_place[places] = [number[k] for k in names]
        self.sizes = np.array([len(s) for _, _, s in rows], np.int64)
        self.copies = np.array([n for _, n, _ in rows], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.ids = np.unique(np.concatenate([s for _, _, s in rows]), return_inverse=True)[1].astype(np.int32)
        self.mark = np.zeros(int(self.ids.max()) + 1, np.int8)
        self.root, self.links = list(range(len(rows))), np.zeros(len(rows), np.int64)

    def top(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def add(self, left: np.ndarray, right: np.ndarray, threshold: Fraction) -> None:
        """Count the shared shingles of a pack of pairs."""
        one, two = self.at_place[left], self.at_place[right]
        by_one = np.argsort(one, kind="stable")
        one, two = one[by_one], two[by_one]
        starts = np.flatnonzero(np.append(True, one[1:] != one[:-1]))
        for a, b in zip(starts.tolist(), np.append(starts[1:], len(one)).tolist(), strict=True):
            i, others = int(one[a]), two[a:b]
            mine = self.ids[self.ends[i] - self.sizes[i] : self.ends[i]]
            self.mark[mine] = 1
            n = self.sizes[others]
            at = np.repeat(self.ends[others] - np.cumsum(n), n) + np.arange(int(n.sum()))
            both = np.add.reduceat(self.mark[self.ids[at]], np.cumsum(n) - n, dtype=np.int64)
            self.mark[mine] = 0
            linked = others[both * threshold.denominator >= (self.sizes[i] + n - both) * threshold.numerator]
            self.links[i] += self.copies[linked].sum()
            self.links[linked] += self.copies[i]
            for j in linked.tolist():
                x, y = self.top(i), self.top(j)
                self.root[max(x, y)] = min(x, y)

    def found(self) -> pa.RecordBatch:
        """key, key of the root of its tree, number of links, for the classes that have links."""
        at = np.flatnonzero(self.links)
        keys = pa.array(self.keys, pa.binary())
        roots = keys.take(pa.array([self.top(i) for i in at.tolist()], pa.int64()))
        return pa.RecordBatch.from_arrays([keys.take(pa.array(at)), roots, pa.array(self.links[at])], names=["set_key", "root", "links"])


def verify(batches: Iterator[pa.RecordBatch], threshold: Fraction) -> Iterator[pa.RecordBatch]:
    """Rows come by pair of blocks, and in each the sets first, then the names of places, then packs of pairs."""
    home, sets, block = None, [], None
    for batch in batches:
        columns = [batch.column(c) for c in (*HOME, "set_key", "rows", "found", "keys", "left", "right")]
        for values in zip(*columns, strict=True):
            one, two, key, n, found, keys, left, right = (v.as_py() for v in values)
            if (one, two) != home:
                if block:
                    yield block.found()
                home, sets, block = (one, two), [], None
            if key is not None:
                sets.append((key, n, np.frombuffer(found, np.uint64)))
            elif keys is not None:
                block = Block(sets, keys, np.frombuffer(left, np.int32))
                sets = []
            else:
                block.add(np.frombuffer(left, np.int32), np.frombuffer(right, np.int32), threshold)
    if block:
        yield block.found()


def linked_classes(docs: DataFrame, classes: DataFrame, tolerance: float, threshold: Fraction, **blocks: int) -> DataFrame:
    """set_key, root, links: partial link counts and tree edges of all verified pairs."""
    packed = cut(candidates(classes, tolerance, threshold, **blocks))
    wanted = packed.select(*HOME, F.explode("keys").alias("set_key"))
    ids = wanted.select("set_key").distinct().join(classes.select("set_key", "doc_id", "text_key", "rows"), "set_key")

    def sets(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        found = [shingles(t) for t in utf8(batch.column("text"))]
        return {
            "key": pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in found], pa.binary()),
            "found": pa.array([s.tobytes() for s in found], pa.binary()),
        }

    chosen = ids.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.unhex(F.md5("text")) == F.col("__key"))  # rows without an id are told apart by their texts
    texts = docs.join(chosen, same, "left_semi").select("text")
    fields = [("key", T.BinaryType()), ("found", T.BinaryType())]
    every = map_rows(texts, sets, fields, []).groupBy("key").agg(F.first("found").alias("found"))
    known = ids.join(every, F.col("set_key") == F.col("key")).select("set_key", "rows", "found")
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    with_sets = wanted.join(known, "set_key").select(
        *HOME, "set_key", "rows", "found", none("array<binary>", "keys"), none("binary", "left"), none("binary", "right")
    )
    with_pairs = packed.select(*HOME, none("binary", "set_key"), none("long", "rows"), none("binary", "found"), "keys", "left", "right")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from verify(batches, threshold)

    kind = F.when(F.col("set_key").isNotNull(), 0).when(F.col("keys").isNotNull(), 1).otherwise(2)
    both = with_sets.unionByName(with_pairs).repartition(*HOME).sortWithinPartitions(*HOME, kind)
    return both.mapInArrow(run, "set_key binary, root binary, links long")


def components(edges: DataFrame) -> DataFrame:
    """key, root for every node of the edges (a, b): the least node of its component, by alternating stars."""
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        edges = cut(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        n, nodes = edges.agg(F.count("*"), F.count_distinct("a")).first()
        if n == nodes and edges.join(edges.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():
            roots = edges.select(F.col("b").alias("key")).distinct().withColumn("root", F.col("key"))
            return roots.unionByName(edges.select(F.col("a").alias("key"), F.col("b").alias("root")))


def grouped(
    docs: DataFrame, block: int = 256, parts: int = 12, most: int = 8192, shingles: int = 4_000_000, tolerance: float = 1e-9, threshold: Fraction = THRESHOLD
) -> DataFrame:
    """doc_id, text_key (MD5 of the text), set_key, group (digest of its first class), class_id and n_links per row."""
    slim = docs.select("doc_id", "text")
    signed = cut(signatures(slim.withColumn("text_key", F.unhex(F.md5("text")))))
    classes = signed.where("size > 0").groupBy("set_key").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_key")).alias("f"), F.count("*").alias("rows"),
        *(F.first(c).alias(c) for c in ("size", "sig", "bands")),
    )
    classes = cut(classes.withColumns({"doc_id": F.col("f.doc_id"), "text_key": F.col("f.text_key")}).drop("f"))
    linked = cut(linked_classes(slim, classes, tolerance, threshold, block=block, parts=parts, most=most, most_shingles=shingles))
    links = linked.groupBy("set_key").agg(F.sum("links").alias("links"))
    trees = components(linked.select(F.col("set_key").alias("a"), F.col("root").alias("b")))
    info = classes.select("set_key", "doc_id", "rows").join(trees.withColumnRenamed("key", "set_key"), "set_key", "left").join(links, "set_key", "left")
    info = info.select("set_key", "doc_id", F.coalesce("root", "set_key").alias("group"), (F.coalesce("links", F.lit(0)) + F.col("rows") - 1).alias("n_links"))
    firsts = info.groupBy("group").agg(F.min("doc_id").alias("class_id"))
    info = info.join(firsts, "group").select("set_key", "group", "class_id", "n_links")
    joined = signed.select("doc_id", "text_key", "set_key").join(info, "set_key", "left")
    empty = F.col("set_key").isNull()
    return joined.select(
        "doc_id", "text_key", "set_key", "group",
        F.when(empty, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )


def op4_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return grouped(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay: of each group the one of least id, then least MD5; all texts without words.

    Only ids and digests travel for the choice; texts stay where they lie, unless several rows agree in id and text.
    """
    groups = grouped(docs, **options)
    order = W.partitionBy("group")
    worded = groups.where("group is not null")
    first = worded.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_key")).alias("f"))
    chosen = first.select(F.col("f.doc_id").alias("__id"), F.col("f.text_key").alias("__text"))
    times = worded.groupBy(F.col("doc_id").alias("__id"), F.col("text_key").alias("__text")).agg(F.count("*").alias("__times"))
    chosen = cut(chosen.join(times, [chosen["__id"].eqNullSafe(times["__id"]), chosen["__text"] == times["__text"]]).select(chosen["__id"], chosen["__text"], "__times"))
    keyed = docs.withColumn("__key", F.unhex(F.md5("text")))
    match = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__text"))
    kept = keyed.join(chosen.where("__times = 1"), match, "left_semi")
    again = keyed.join(chosen.where("__times > 1"), match, "left_semi").dropDuplicates(["doc_id", "__key"])
    wordless = keyed.where(~F.coalesce("text", F.lit("")).rlike(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"))
    return kept.unionByName(again).unionByName(wordless).select(docs.columns)


OP4_SQL = r"""
with words as (
  select row_number() over () as r, doc_id, text,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents),
sets as materialized (
  select distinct r, array_to_string(w[i:i + 4], ' ') as s
  from (select r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from words where len(w) > 0) x),
sizes as (select r, count(*) as n from sets group by r),
links as materialized (
  select p.a, p.b from (
    select x.r as a, y.r as b, count(*) as both from sets x join sets y on x.s = y.s and x.r <> y.r group by x.r, y.r) p
  join sizes u on u.r = p.a join sizes v on v.r = p.b
  where p.both * 5 >= (u.n + v.n - p.both) * 4),
reach as (
  with recursive go(a, b) as (select r, r from words union select go.a, links.b from go join links on links.a = go.b)
  select a, b from go),
groups as (select reach.a, min(words.doc_id) as class_id from reach join words on words.r = reach.b group by reach.a),
counts as (select a, count(*) as n from links group by a)
select doc_id, class_id, coalesce(n, 0) as n_links
from words join groups on groups.a = words.r left join counts on counts.a = words.r
"""
