"""Documents as bags of subwords: learned vectors of hashed words and character n-grams, averaged, then softmax.

Each word stands for itself (hashed) and for its character n-grams, so an unseen misspelling shares most of its
vector with the word it comes from.  A document's vector is the average of its words' vectors; a linear softmax
follows.  Vectors and softmax are trained jointly by minibatch stochastic gradient descent in numpy, with a step
per bucket that shrinks as the bucket's gradients add up, as rare buckets hardly move otherwise.

The average and the softmax are linear up to the last step, so for scoring each bucket shrinks to one number and
each word to the mean of its buckets' numbers; a document's logit is the mean over all its words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.llm.batches import held_out, map_rows

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Settings:
    """``per_label``: labelled documents of class 0 and of class 1 that are learned from, at most."""

    label: str
    lower: bool
    shortest: int = 3
    longest: int = 5
    buckets: int = 1 << 18
    width: int = 5
    per_label: tuple[int, int] = (4000, 1500)
    epochs: int = 6
    batch: int = 32
    rate: float = 1.0
    seed: int = 11


def words_of(text: str | None, lower: bool) -> list[str]:
    return (text.lower() if lower else text).split() if text else []


def buckets_of(words: list[str], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words one after another, and where each word's begin."""
    marked = [f"<{w}>" for w in words]
    lengths = np.array([len(w) for w in marked], np.int64)
    points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(points))  # letters from here to the word's end
    with np.errstate(over="ignore"):
        code, keys, owners = np.zeros(len(points), np.uint64), [], []
        for n in range(1, s.longest + 1):
            code[: len(points) - n + 1] = code[: len(points) - n + 1] * MULTIPLIER + points[n - 1 :] + np.uint64(1)
            if n >= s.shortest:
                fits = np.flatnonzero(left >= n)
                keys.append(code[fits] + np.uint64(n))
                owners.append(owner[fits])
        begins = np.cumsum(lengths) - lengths
        power = np.power(MULTIPLIER, np.arange(int(lengths.max()), dtype=np.uint64))
        keys.append(np.add.reduceat(points * power[np.arange(len(points)) - np.repeat(begins, lengths)], begins))
        owners.append(np.arange(len(words)))
        key, who = np.concatenate(keys), np.concatenate(owners)
        key ^= key >> np.uint64(32)
        key *= MULTIPLIER
    order = np.argsort(who, kind="stable")
    found = (key[order] >> np.uint64(40)).astype(np.int64) % s.buckets
    return found, np.searchsorted(who[order], np.arange(len(words)))


def known_labels(labels: DataFrame, s: Settings) -> DataFrame:
    """doc_id and label of the rows that may be learned from, each pair once."""
    return labels.select("doc_id", F.col(s.label).cast("int").alias("__y")).na.drop().where(~held_out()).distinct()


def sample(docs: DataFrame, labels: DataFrame, s: Settings) -> pa.Table:
    """Columns __y, words (joined by blanks) and counts of up to ``per_label`` documents of each class, none held out.

    The choice follows a hash of the id, so it is the same in every run; texts are counted where they lie and
    only the counts come to the driver, as Arrow columns.
    """
    known = known_labels(labels, s)
    chosen = [
        known.where(F.col("__y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.per_label[y]) for y in (0, 1)
    ]
    wanted = F.broadcast(chosen[0].unionByName(chosen[1]))
    met = docs.select("doc_id", "text").join(wanted, "doc_id")
    # rows that repeat an id count once: the text of the least digest, so that the sample is bounded in rows
    first = met.groupBy("doc_id", "__y").agg(F.min(F.md5("text")).alias("__digest"))
    picked = met.withColumn("__digest", F.md5("text")).join(F.broadcast(first), ["doc_id", "__y", "__digest"]).drop("__digest")
    picked = picked.dropDuplicates(["doc_id", "__y"])

    def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        counts = [Counter(words_of(t, s.lower)) for t in batch.column("text").to_pylist()]
        return {
            "words": pa.array([" ".join(c) for c in counts], pa.string()),
            "counts": pa.array([list(c.values()) for c in counts], pa.list_(pa.int32())),
        }

    fields = [("words", T.StringType()), ("counts", T.ArrayType(T.IntegerType()))]
    rows = map_rows(picked, work, fields, ["doc_id", "__y"]).where("words <> ''").toArrow()
    return rows.sort_by([("doc_id", "ascending"), ("__y", "ascending"), ("words", "ascending")])


def one_by_one(rows: pa.Table) -> Iterator[tuple[int, list[str], list[int]]]:
    """Label, words and counts of each sampled document; only one document exists as Python objects at a time."""
    for y, words, counts in zip(*(rows.column(c) for c in ("__y", "words", "counts")), strict=True):
        yield y.as_py(), words.as_py().split(), counts.as_py()


def train(rows: Iterable[tuple[int, list[str], list[int]]], s: Settings) -> tuple[np.ndarray, float]:
    """One number per bucket and a constant: the logit of class 1 against class 0."""
    vocabulary: dict[str, int] = {}
    labels, bags = [], []
    for label, words, counts in rows:
        labels.append(label)
        bags.append((np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words], np.int32), np.array(counts, np.int32)))
    y = np.array(labels, np.int64)
    if len(set(labels)) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        return np.zeros(s.buckets, np.float32), float(np.log(share / (1 - share)))
    names, flat, sizes = list(vocabulary), [], []
    for at in range(0, len(names), 20_000):  # words are hashed alone; parts bound the arrays that exist at a time
        found, begins = buckets_of(names[at : at + 20_000], s)
        flat.append(found.astype(np.int32))
        sizes.append(np.diff(np.append(begins, len(found))))
    del vocabulary, names
    flat, sizes = np.concatenate(flat), np.concatenate(sizes)
    begins = np.cumsum(sizes) - sizes
    column, value = [], []
    for ids, counts in bags:
        n = sizes[ids]
        share = counts / counts.sum() / n
        at = np.repeat(begins[ids] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        bucket, back = np.unique(flat[at], return_inverse=True)
        column.append(bucket)
        value.append(np.bincount(back, np.repeat(share, n)).astype(np.float32))
    del bags, flat
    rng = np.random.RandomState(s.seed)
    vectors = (rng.uniform(-1, 1, (s.buckets, s.width)) / s.width).astype(np.float32)
    weights, bias = rng.normal(0, 1, (s.width, 2)).astype(np.float32), np.zeros(2)
    seen = np.full(s.buckets, 1e-8)
    for epoch in range(s.epochs):
        rate = s.rate * (1 - epoch / s.epochs)
        order = rng.permutation(len(y))
        for at in range(0, len(order), s.batch):
            batch = order[at : at + s.batch]
            cols, vals = np.concatenate([column[i] for i in batch]), np.concatenate([value[i] for i in batch])
            sizes_of = np.array([len(column[i]) for i in batch])
            own = np.repeat(np.arange(len(batch)), sizes_of)
            mean = np.add.reduceat(vectors[cols] * vals[:, None], np.cumsum(sizes_of) - sizes_of)
            logits = mean @ weights + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            delta = (p / p.sum(1, keepdims=True) - np.eye(2)[y[batch]]) / len(batch)
            pull = np.bincount(cols, vals * delta[own, 1], s.buckets)  # of two classes, one pull is minus the other
            touched = np.flatnonzero(pull)
            step = pull[touched, None] * (weights[:, 1] - weights[:, 0])
            seen[touched] += (step**2).mean(1)
            vectors[touched] -= (rate * step / np.sqrt(seen[touched])[:, None]).astype(np.float32)
            weights -= (rate * mean.T @ delta).astype(np.float32)
            bias -= rate * delta.sum(0)
    return (vectors @ (weights[:, 1] - weights[:, 0])).astype(np.float32), float(bias[1] - bias[0])


class Scorer:
    """Scores words once and documents as means; the table of known words is emptied when it grows too large."""

    def __init__(self, table: np.ndarray, bias: float, s: Settings, most: int = 300_000) -> None:
        self.table, self.bias, self.s, self.most, self.known = table, bias, s, most, {}

    def __call__(self, texts: list[str | None]) -> Iterator[float]:
        docs = [words_of(t, self.s.lower) for t in texts]
        if len(self.known) > self.most:
            self.known = {}
        if fresh := list(set().union(*docs).difference(self.known)):
            flat, begins = buckets_of(fresh, self.s)
            sizes = np.diff(np.append(begins, len(flat)))
            self.known.update(zip(fresh, (np.add.reduceat(self.table[flat].astype(np.float64), begins) / sizes).tolist(), strict=True))
        get = self.known.__getitem__
        for words in docs:
            yield 1 / (1 + np.exp(-np.clip((sum(map(get, words)) / len(words) if words else 0.0) + self.bias, -500, 500)))


def classify(docs: DataFrame, labels: DataFrame, s: Settings, threshold: float) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``.

    Edge cases: null and empty texts score the constant alone; without labels of both classes every text scores
    the (smoothed) share of class 1; rows with a null id are scored, never learned from, and not held out.
    Conflicting or repeated labels of one document are all learned from, once each.  Texts of any length are scored whole.  A score
    that equals the threshold is predicted.  Repeated rows are each scored.  Only doc_id and text are read, so no other column can
    clash.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = sample(docs, labels, s)
    bucket_values, bias = train(one_by_one(rows), s)
    model = spark.sparkContext.broadcast((bucket_values, bias))
    held: dict[str, Scorer] = {}

    def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        scorer = held.setdefault("it", Scorer(*model.value, s))
        return {"score": pa.array(scorer(batch.column("text").to_pylist()), pa.float64())}

    scored = map_rows(docs.select("doc_id", "text"), work, [("score", T.DoubleType())], ["doc_id"], 256)
    return scored.select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
