"""Benchmark decontamination: an FM-index over each shard of documents, searched for benchmark windows.

A window is ``width`` consecutive words of a benchmark item (an item of fewer words, but not none, is one
window).  Every shard (a slice of the rows a task holds) becomes one symbol sequence.  Words that no item has
can take part in no occurrence, so they become one separator, and stretches of item words shorter than the
shortest window are left out for the same reason; the index is built over the rest.  Windows are searched
backwards through the wavelet tree, occurrences are located by sampled suffix positions, and overlapping
occurrences merge into removal spans.

Benchmark windows travel to the tasks in blocks of about ``block_bytes``, dealt by a hash of the item.  The driver builds
one block at a time and keeps none: a broadcast lies in a file and in Spark's block manager.  A larger benchmark is searched in
more passes over the same rows, each pass carried on by the next, without a shuffle.

Edge cases: a null or empty text has no words, no hits and stays as it is.  A null item text has no windows.
Windows of items without an id are hit and cut like others; all such items count as one, and give no id to the list.
Repeated documents are each reported; repeated items with different ids each count, repeated rows of one
item_id count once.  Texts of any length are searched whole.  No documents or no items: no hits.  Other columns pass through
untouched, but for those named ``__words``, ``__spans`` and ``__items``, which are replaced.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.llm.batches import folded_words, map_rows, table, utf8
from strandlake.llm.fm_index import FMIndex

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOUND = "__spans"
ITEMS = "__items"


class Windows:
    """The distinct windows of a block of items, by length, over a common vocabulary."""

    def __init__(self, width: int) -> None:
        self.width = width
        self.vocabulary: dict[bytes, int] = {}
        self.owners: dict[tuple[int, ...], set[str]] = defaultdict(set)

    def add(self, item: str, text: bytes) -> None:
        words = folded_words(text)
        ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
        for at in range(max(1, len(ids) - self.width + 1) if ids else 0):
            self.owners[tuple(ids[at : at + self.width])].add(item)

    def by_length(self) -> list[tuple[np.ndarray, list[list[str]]]]:
        groups: dict[int, list[tuple[int, ...]]] = defaultdict(list)
        for window in self.owners:
            groups[len(window)].append(window)
        return [(np.array(g, np.int64), [sorted(self.owners[w]) for w in g]) for _, g in sorted(groups.items())]


#: Stands for the items without an id.
NO_ID = "\0"


def blocks(benchmark: DataFrame, width: int, block_bytes: int) -> Iterator[Windows]:
    """Items dealt to as many blocks as their estimated size asks for; each comes to the driver alone."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit(NO_ID)).alias("item"), F.col("text").cast("string")).na.drop()
    held = items.agg(F.sum(F.octet_length("text") + 200 * F.size(F.split("text", "[^0-9A-Za-z\u0080-\U0010ffff]+")))).first()[0] or 0
    many = -(-held // block_bytes)
    for k in range(many):
        now = Windows(width)
        for row in items.where(F.pmod(F.xxhash64("item", "text"), F.lit(many)) == k).toLocalIterator():
            now.add(row[0], row[1].encode())
        if now.owners:
            yield now
            del now


def occurrences(texts: list[list[bytes]], vocabulary: dict[bytes, int], windows: list, sample: int):
    """(document, first word, last word, owners) of every place where a window stands in a shard."""
    get, shortest = vocabulary.get, min(w.shape[1] for w, _ in windows)
    lengths = np.array([len(t) + 1 for t in texts])
    ids = np.fromiter((x for t in texts for x in (*(get(w, 0) for w in t), 0)), np.int64, int(lengths.sum()))
    known = np.concatenate(([0], (ids > 0).astype(np.int8), [0]))
    turns = np.flatnonzero(np.diff(known))
    start, end = turns[::2], turns[1::2]
    long = end - start >= shortest
    start, end = start[long], end[long]
    if not len(start):
        return
    size = end - start + 1  # with a separator after each stretch
    begins = np.concatenate(([0], np.cumsum(size)[:-1]))
    place = np.arange(int(size.sum())) - np.repeat(begins, size) + np.repeat(start, size)
    index = FMIndex(ids[place] * (place < np.repeat(end, size)), len(vocabulary) + 1, sample)
    ends = np.cumsum(lengths)
    for patterns, owners in windows:
        low, high = index.search(patterns)
        hit = np.flatnonzero(high > low)
        many = high[hit] - low[hit]
        rows = np.repeat(low[hit] - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(int(many.sum()))
        at = place[index.locate(rows)]
        doc = np.searchsorted(ends, at, side="right")
        first = at - (ends - lengths)[doc]
        for d, f, w in zip(doc.tolist(), first.tolist(), np.repeat(hit, many).tolist(), strict=True):
            yield d, f, f + patterns.shape[1] - 1, owners[w]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of inclusive word ranges, touching ones joined."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    return out


SPANS = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))
ARROW_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def find(docs: DataFrame, benchmark: DataFrame, width: int = 10, sample: int = 16, shard_rows: int = 4096,
         block_bytes: int = 64_000_000) -> DataFrame:
    """``docs`` with ``__words`` (long), ``__spans`` (merged word ranges) and ``__items`` (ids with hits)."""
    fields = [("__words", T.LongType()), (FOUND, SPANS), (ITEMS, T.ArrayType(T.StringType()))]
    stay = [c for c in docs.columns if c not in ("__words", FOUND, ITEMS)]

    context = docs.sparkSession.sparkContext
    sent = [context.broadcast((block.vocabulary, block.by_length())) for block in blocks(benchmark, width, block_bytes)]

    def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        texts = [folded_words(t) for t in utf8(batch.column("text"))]
        spans, items = [[] for _ in texts], [set() for _ in texts]
        for block in sent:
            vocabulary, windows = block.value
            for doc, first, last, owners in occurrences(texts, vocabulary, windows, sample) if windows else ():
                spans[doc].append((first, last))
                items[doc].update(owners)
            if len(sent) > 1:
                block.__dict__.pop("_value", None)  # a task holds one block at a time; the next shard reads it from disk again
        return {
            "__words": pa.array([len(t) for t in texts], pa.int64()),
            FOUND: pa.array([[{"first": a, "last": b} for a, b in merged(x)] for x in spans], ARROW_SPANS),
            ITEMS: pa.array([sorted(x) for x in items], pa.list_(pa.string())),
        }

    return map_rows(docs.select(stay), work, fields, stay, shard_rows)


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the words of removal spans; rows without a hit stay byte for byte.

    Each span goes with what stands between its words.  ``n_chars``, where there is one, follows the text.
    """

    def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        out = []
        for text, spans in zip(utf8(batch.column("text")), batch.column(FOUND).to_pylist(), strict=True):
            if spans:
                words = [m.span() for m in WORD.finditer(text.lower())]  # bytes.lower() changes A-Z only
                kept, at = [], 0
                for s in spans:
                    kept.append(text[at : words[s["first"]][0]])
                    at = words[s["last"]][1]
                text = b"".join([*kept, text[at:]])
            out.append(text if text is None else text.decode())
        return {"__clean": pa.array(out, pa.string())}

    found = map_rows(find(docs, benchmark, **options), work, [("__clean", T.StringType())], [*docs.columns, FOUND])
    out = found.withColumn("text", F.col("__clean"))
    if "n_chars" in docs.columns:
        changed = F.when(F.size(FOUND) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", changed)
    return out.select(docs.columns)


def op5_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find(docs, table(spark, sf_dir, "benchmark"))
    hits = F.aggregate(FOUND, F.lit(0).cast("long"), lambda acc, s: acc + s["last"] - s["first"] + 1)
    return found.select(
        "doc_id",
        F.col("__words").alias("n_words"),
        hits.alias("n_hit"),
        F.size(ITEMS).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_remove(ITEMS, NO_ID), ","), 256).alias("items_sha256"),
        (F.size(FOUND) > 0).alias("contaminated"),
    )


OP5_SQL = r"""
with item_words as (
  select coalesce(cast(item_id as varchar), chr(0)) as item_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark where text is not null),
windows as (
  select distinct item_id, least(len(w), 10) as width, array_to_string(w[i:i + 9], ' ') as win
  from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from item_words where len(w) > 0) x),
widths as (select distinct width from windows),
doc_words as (
  select row_number() over () as r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents),
places as (
  select r, i, width, array_to_string(w[i:i + width - 1], ' ') as win
  from (select r, w, unnest(range(1, len(w) + 1)) as i from doc_words) x, widths where i + width - 1 <= len(w)),
hits as (select r, i, p.width, item_id from places p join windows on windows.win = p.win and windows.width = p.width),
hit_words as (select r, count(distinct pos) as n from (select r, unnest(range(i, i + width)) as pos from hits) x group by r),
hit_items as (select r, count(*) as n, string_agg(item_id, ',' order by item_id) filter (where item_id <> chr(0)) as ids
              from (select distinct r, item_id from hits) x group by r)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(h.n, 0) as n_hit, coalesce(t.n, 0) as n_items,
       sha256(coalesce(t.ids, '')) as items_sha256, coalesce(h.n, 0) > 0 as contaminated
from doc_words d left join hit_words h on h.r = d.r left join hit_items t on t.r = d.r
"""
