"""Vector code compression: every vector becomes 16 one-byte codes, learned exactly in integers.

Components become integers; a vector is cut into equal parts, and each part position has a codebook of at most 64 entries.  Vectors are packed
into chunks of at most ``rows`` vectors, each a row of its own that no later step shuffles.  In a chunk the parts of one position
are sorted along a Hilbert curve and cut into flat blocks of ``BLOCK`` points, which store their min/max boxes and their sums.
A round computes the least and greatest distance from every box to every entry: an entry whose least distance is above another's greatest
is nearest to no point of the block.  What remains is the block's shortlist.  A shortlist of one takes the whole block, by its
sums; the others go through a small exact integer kernel.  So pruning never changes a result.  Tasks give one row for each
entry (sums, count); these are added by Spark, and the new codebook, whose size is a parameter, comes to the driver.

Edge cases: rows whose vector is null or holds a null or a non-finite component are dropped, as are those of another length than
that of the smallest kept vec_id, and all if that is no multiple of the number of parts.  Integers beyond 2**24 either way count as 2**24, so that all sums are exact.
Null ids are kept and come last in the choice of first entries; rows of equal ids are coded each, and come in the order of their vectors there.  With fewer than 64 kept
rows the codebooks have as many entries.  Ties go to the lower index.  Equal rows get equal codes.  A null label is a label of its own.  Only vec_id, embedding and
label are read, so other columns cannot clash.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.llm.batches import cut, table

PARTS, ENTRIES, ROUNDS, BLOCK = 16, 64, 2, 128
LIMIT = 1 << 24
#: A label with this share of the rows at least is joined by broadcast; there can be no more than this many.
HEAVY = 512


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Places along a Hilbert curve of ``points`` (n, dimensions; integers below 2 ** bits), by Skilling's transposed form."""
    x = np.array(points.T, dtype=np.int64)
    for k in range(bits - 1, 0, -1):
        low = (1 << k) - 1
        for i in range(len(x)):
            set_ = (x[i] >> k) & 1 == 1
            swap = np.where(set_, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(set_, low, swap)
            x[i] ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for k in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> k) & 1 == 1, (1 << k) - 1, 0)
    x ^= turn
    place = np.zeros_like(turn)
    for k in range(bits - 1, -1, -1):
        for axis in x:
            place = place << 1 | (axis >> k) & 1
    return place


def order_of(part: np.ndarray) -> np.ndarray:
    """Order of points along the curve through their box; dimensions after the twelfth have no say in it."""
    some = part[:, :12].astype(np.int64)
    bits = min(16, 62 // some.shape[1])
    some -= some.min(0)
    shift = max(int(some.max()).bit_length() - bits, 0)
    return np.argsort(hilbert(some >> shift, bits), kind="stable")


def whole_numbers(vectors: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(256 * vectors.astype(np.float64)), -LIMIT, LIMIT).astype(np.int32)


class Blocks:
    """The points of one part position of a chunk, in the order of the curve, with boxes and sums of their blocks."""

    def __init__(self, points: np.ndarray, low: np.ndarray, high: np.ndarray, sums: np.ndarray) -> None:
        self.points, self.low, self.high, self.sums = points, low, high, sums
        self.starts = range(0, len(points), BLOCK)

    def assigned(self, entries: np.ndarray, errors: bool) -> tuple[np.ndarray, np.ndarray | None, np.ndarray, np.ndarray]:
        """Entry and (if asked for) squared distance of every point; sums and counts of all entries."""
        low, high, e = self.low[:, None].astype(np.int64), self.high[:, None].astype(np.int64), entries[None]
        least = (np.maximum(np.maximum(low - e, e - high), 0) ** 2).sum(2)
        most = (np.maximum(np.abs(e - low), np.abs(high - e)) ** 2).sum(2)
        short = least <= most.min(1)[:, None]
        index, far = np.empty(len(self.points), np.int16), np.empty(len(self.points), np.int64) if errors else None
        sums, counts = np.zeros_like(entries), np.zeros(len(entries), np.int64)
        for b, start in enumerate(self.starts):
            chosen, points = np.flatnonzero(short[b]), self.points[start : start + BLOCK].astype(np.int64)
            if len(chosen) == 1 and not errors:
                index[start : start + BLOCK] = chosen[0]
                sums[chosen[0]] += self.sums[b]
                counts[chosen[0]] += len(points)
                continue
            gap = points[:, None] - entries[chosen][None]
            distance = np.einsum("ijk,ijk->ij", gap, gap)
            own = distance.argmin(1)
            index[start : start + BLOCK] = chosen[own]
            if errors:
                far[start : start + BLOCK] = distance[np.arange(len(own)), own]
            else:
                np.add.at(sums, chosen[own], points)
                counts += np.bincount(chosen[own], minlength=len(entries))
        return index, far, sums, counts


#: Arrays (part, place or block, component) of a chunk; ``orders`` has no components.
CHUNK = "n long, width int, points binary, low binary, high binary, sums binary, orders binary"


def packed(kept: DataFrame, dims: int, rows: int) -> DataFrame:
    """Chunks of ``kept`` (vec_id, embedding, label): vec_ids, labels, and points and orders of all part positions."""
    kinds = {c: kept.schema[c].dataType for c in ("vec_id", "label")}
    schema = T.StructType([T.StructField(f"{c}s", T.ArrayType(k)) for c, k in kinds.items()] + T._parse_datatype_string(CHUNK).fields)

    def chunk(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(held).combine_chunks()
        n = whole.num_rows
        flat = pa.concat_arrays([c.flatten() for c in whole.column("embedding").chunks])
        values = whole_numbers(flat.to_numpy(zero_copy_only=False)).reshape(n, PARTS, dims // PARTS)
        small = np.abs(values).max() < 1 << 15
        orders = np.stack([order_of(values[:, p]) for p in range(PARTS)]).astype(np.int32)
        points = np.stack([values[o, p] for p, o in enumerate(orders)]).astype(np.int16 if small else np.int32)
        starts = np.arange(0, n, BLOCK)
        low, high = np.minimum.reduceat(points, starts, axis=1), np.maximum.reduceat(points, starts, axis=1)
        sums = np.add.reduceat(points, starts, axis=1, dtype=np.int64)
        lists = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), pa.concat_arrays(whole.column(c).chunks)) for c in kinds]
        rest = [pa.array([n], pa.int64()), pa.array([points.itemsize], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (points, low, high, sums, orders))]
        return pa.RecordBatch.from_arrays(lists + rest, names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, rows - n)
                held.append(part)
                n, batch = n + part.num_rows, batch.slice(part.num_rows)
                if n == rows:
                    yield chunk(held)
                    held, n = [], 0
        if held:
            yield chunk(held)

    return kept.mapInArrow(run, schema)


def unpacked(batch: pa.RecordBatch, at: int, dims: int) -> tuple[list[Blocks], np.ndarray]:
    """The blocks of every part position of a chunk, and its orders (part, place)."""
    column = lambda c: batch.column(batch.schema.get_field_index(c))[at]
    n, kind = column("n").as_py(), np.int16 if column("width").as_py() == 2 else np.int32
    array = lambda c, kind: np.frombuffer(column(c).as_buffer(), kind).reshape(PARTS, -1, dims // PARTS)
    each = zip(array("points", kind), array("low", kind), array("high", kind), array("sums", np.int64), strict=True)
    return [Blocks(*x) for x in each], np.frombuffer(column("orders").as_buffer(), np.int32).reshape(PARTS, n)


def next_books(chunks: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round.  books: part, entry, component."""
    parts, n, width = books.shape
    sums = [f"s{i}" for i in range(width)]
    schema = "part int, entry int, n long, " + ", ".join(f"{s} long" for s in sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_sums, counts = np.zeros_like(books), np.zeros((parts, n), np.int64)
        for batch in batches:
            for at in range(batch.num_rows):
                for p, blocks in enumerate(unpacked(batch, at, parts * width)[0]):
                    _, _, s, c = blocks.assigned(books[p], errors=False)
                    all_sums[p] += s
                    counts[p] += c
        p, e = np.nonzero(counts)
        found = [p.astype(np.int32), e.astype(np.int32), counts[p, e], *all_sums[p, e].T]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in found], names=["part", "entry", "n", *sums])

    each = chunks.drop("vec_ids", "labels").mapInArrow(run, schema)
    out = books.copy()
    for r in each.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(s).alias(s) for s in sums)).collect():
        out[r["part"], r["entry"]] = [r[s] // r["n"] for s in sums]
    return out


def coded(chunks: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code (one byte for each part), error (long)."""
    kinds = [(c, chunks.schema[f"{c}s"].dataType.elementType) for c in ("vec_id", "label")]
    schema = T.StructType([T.StructField(c, k) for c, k in kinds] + [T.StructField("code", T.BinaryType()), T.StructField("error", T.LongType())])
    parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                blocks, orders = unpacked(batch, at, parts * width)
                n = orders.shape[1]
                code, error = np.empty((n, parts), np.uint8), np.zeros(n, np.int64)
                for p in range(parts):
                    index, far, _, _ = blocks[p].assigned(books[p], errors=True)
                    code[orders[p], p] = index
                    error[orders[p]] += far
                own = [batch.column(batch.schema.get_field_index(f"{c}s"))[at].values for c, _ in kinds]
                bytes_ = pa.FixedSizeBinaryArray.from_buffers(pa.binary(parts), n, [None, pa.py_buffer(code.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([*own, bytes_, pa.array(error)], names=schema.names)

    return chunks.mapInArrow(run, schema)


def compress(vectors: DataFrame, rows: int = 16_384) -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, code and error of every usable row of ``vectors`` (vec_id, embedding, label), and the codebooks."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & (x > F.lit(float("-inf"))) & (x < F.lit(float("inf"))))
    kept = vectors.select("vec_id", "embedding", "label").where(F.col("embedding").isNotNull() & finite)
    first = kept.select("vec_id", "embedding").orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(1).collect()
    dims = len(first[0]["embedding"]) if first else 0
    if not dims or dims % PARTS:
        kept, dims = kept.where("false"), PARTS
    kept = kept.where(F.size("embedding") == dims)
    first = kept.select("vec_id", "embedding").orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(ENTRIES).collect()
    start = np.array([r["embedding"] for r in first], dtype=np.float64).reshape(len(first), dims)
    books = np.ascontiguousarray(whole_numbers(start).astype(np.int64).reshape(len(first), PARTS, dims // PARTS).transpose(1, 0, 2))
    chunks = cut(packed(kept, dims, rows))
    for _ in range(ROUNDS if len(first) else 0):
        books = next_books(chunks, books)
    return coded(chunks, books), books


def with_label_error(rows: DataFrame) -> DataFrame:
    """``rows`` (label, error, ...) with label_error.

    Labels that hold a 512th of the rows or more are at most 512; their sums are broadcast.  The rows of the others are dealt by label.
    """
    sums = cut(rows.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")).withColumnRenamed("label", "of"))
    total = sums.agg(F.sum("n")).first()[0] or 0
    heavy, light = (sums.where(test).drop("n") for test in (F.col("n") * HEAVY >= total, F.col("n") * HEAVY < total))
    same = F.col("label").eqNullSafe(F.col("of"))
    few = rows.join(F.broadcast(heavy), same)
    rest = rows.join(F.broadcast(heavy.select("of")), same, "left_anti").join(light.hint("merge"), same)
    return few.unionByName(rest).drop("of")


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    found, books = compress(table(spark, sf_dir, "embeddings"))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return with_label_error(cut(found)).select(
        "vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256")
    )


def assigned_sql(books: str) -> str:
    """vec_id, part, x, entry and far (squared distance) of the entry of ``books`` that is nearest to each part."""
    far = "list_sum(list_transform(list_zip(x, e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint"
    return f"""
  select vec_id, part, any_value(x) as x, min(struct_pack(far := far, entry := entry)) as best from (
    select vec_id, p.part, x, entry, {far} as far from parts p join {books} b on b.part = p.part) group by vec_id, part"""


def op13_sql() -> str:
    rounds = []
    for k in range(ROUNDS):
        rounds.append(f"a{k} as ({assigned_sql(f'b{k}')})")
        rounds.append(f"""b{k + 1} as (
  select part, entry, coalesce(new.e, old.e) as e from b{k} old left join (
    select part, entry, list(floor(s / n)::bigint order by i) as e from (
      select part, best.entry as entry, i, sum(x[i]) as s, count(*) as n from a{k}, range(1, (select dims + 1 from width)) r(i) group by all)
    group by all) new using (part, entry))""")
    return f"""
with kept as (
  select vec_id, label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
width as (select any_value(len(v)) // {PARTS} as dims from kept),
parts as (select vec_id, part, v[part * dims + 1:(part + 1) * dims] as x from kept, width, range({PARTS}) r(part)),
b0 as (select part, row_number() over (partition by part order by vec_id) - 1 as entry, x as e from parts
       where vec_id in (select vec_id from kept order by vec_id limit {ENTRIES})),
{', '.join(rounds)},
final as ({assigned_sql(f'b{ROUNDS}')}),
codes as (
  select vec_id, string_agg(printf('%02x', best.entry), '' order by part) as code, sum(best.far)::bigint as error from final group by vec_id),
books as (select sha256(string_agg(array_to_string(e, ','), ',' order by part, entry)) as codebooks_sha256 from b{ROUNDS})
select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, codebooks_sha256
from codes join kept using (vec_id), books
"""
