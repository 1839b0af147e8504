r"""Masked pseudo-likelihood: a two-sided window network predicts every word from the words around it.

Tokens are the words ``[^\x20\x09-\x0D]+``, of any length.  The most frequent words of the corpus stand for
themselves: as many as ``vocabulary`` says, by default 10 times the root of the number of tokens and 20,000 at least,
so the vocabulary follows the corpus.  Of words of equal frequency all belong to it or none.  Rarer words
are hashed into a quarter as many groups.  Words and groups are the leaves of a Huffman tree, and

    P(word | two words before, two after) = product over the word's path of P(turn at the node | words around)

times ``1 / number of different words`` for a word of a group.  The network embeds the words (or groups) around, one
hidden tanh layer follows, and each node of the tree has its own vector and constant, so context takes part in every
factor down to the leaf.  The constants start at the counts of the whole corpus, which is the unigram model.

Every window of every document is learned from (a caller may ask for one of ``every``, by a hash of the text and the place).  Whole
documents are dealt and sorted by a hash of id and text, their windows are made in the task that learns them and shuffled there in
runs of ``MIXED`` steps, and numpy takes one step of AdaGrad per ``BATCH`` windows, so only texts travel.  A share of the documents,
with about ``block`` windows, comes first and trains one network.  Each part of the other documents, of ``block`` windows or of forty
windows a leaf if that is more, trains a copy of it (parts and network both grow as the root of the corpus), and Spark mixes the
copies: the change of each row of parameters is the mean over the parts, weighted by the squared gradients it has met there, so a word
counts where it was seen.  Only words and one network reach the driver.

A document's ``log_prob`` is the sum of its tokens' conditional log-probabilities; ``score`` is the mean.

Edge cases: null and empty texts have no tokens, log_prob 0 and a null score.  An empty corpus gives no rows.
Repeated rows count as often as they stand.  A document of one token has edge marks all around.  Texts of any length are scored
whole.  Words of equal frequency are ordered by their letters.  Only doc_id and text are read, so other columns cannot clash.  Results
depend on the set of rows only, not on their order or partitions, up to rounding of 4-byte floats (if Spark keeps the number of parts).
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator
from copy import copy

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.llm.batches import BLANKS, cut, map_rows, table, utf8

#: Places of the neighbours, relative to the token.
PLACES = (-2, -1, 1, 2)
#: Windows of one step of training.
BATCH = 1024
#: Steps whose windows are shuffled among each other.
MIXED = 64
#: Heaviest nodes of the tree, whose values are computed for all windows at once.
TOP = 256
#: Bytes of a word from which on its digest stands for it.
LONG = 64


def key_of(word: bytes) -> bytes:
    """The word, or a digest of a long one; the blank keeps digests apart from words."""
    return word if len(word) <= LONG else b" " + hashlib.md5(word).hexdigest().encode()


def word_counts(docs: DataFrame) -> DataFrame:
    """word (as ``key_of`` gives it), n over all texts."""
    words = docs.select(F.explode(F.split("text", BLANKS)).alias("word")).where("word <> ''")
    key = F.when(F.octet_length("word") <= LONG, F.col("word")).otherwise(F.concat(F.lit(" "), F.md5(F.col("word").cast("binary"))))
    return words.groupBy(key.alias("word")).agg(F.count("*").alias("n"))


class Words:
    """Leaves of words: the vocabulary first, then the groups of rarer words."""

    def __init__(self, words: list[tuple[str, int]], rare: list[tuple[int, int, int]], groups: int) -> None:
        words, rare = sorted(words, key=lambda w: (-w[1], w[0])), sorted(rare)
        self.ids = {w.encode(): i for i, (w, _) in enumerate(words)}
        self.counts = np.array([n for _, n in words] + [n for _, n, _ in rare], np.float64)
        self.within = -np.log(np.array([1] * len(words) + [many for _, _, many in rare], np.float64))
        self.groups = [0] * groups
        for at, (g, _, _) in enumerate(rare, len(words)):
            self.groups[g] = at

    def leaf(self, word: bytes) -> int:
        key = key_of(word)
        at = self.ids.get(key)
        return self.groups[zlib.crc32(key) % len(self.groups)] if at is None else at

    def tokens(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Leaves of all tokens, the tokens of the same text before each, and the number of tokens of each text."""
        get, leaf, crc, groups, many = self.ids.get, self.leaf, zlib.crc32, self.groups, len(self.groups)
        words = [t.split() if t else [] for t in texts]
        sizes = np.array([len(w) for w in words], np.int64)
        each = (
            at if (at := get(w)) is not None else groups[crc(w) % many] if len(w) <= LONG else leaf(w) for text in words for w in text
        )
        ids = np.fromiter(each, np.int32, int(sizes.sum()))
        return ids, np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes), sizes

    def around(self, ids: np.ndarray, before: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Leaves around the tokens ``at``; the number of leaves marks an edge."""
        first, after = before[at], np.repeat(sizes, sizes)[at] - before[at]
        out = np.full((len(at), len(PLACES)), len(self.counts), np.int32)
        for k, place in enumerate(PLACES):
            there = np.flatnonzero(first >= -place if place < 0 else after > place)
            out[there, k] = ids[at[there] + place]
        return out


def learn_words(docs: DataFrame, vocabulary: int | None) -> Words:
    counts = cut(word_counts(docs))
    by_count = sorted((tuple(r) for r in counts.groupBy("n").agg(F.count("*")).collect()), reverse=True)
    most = vocabulary or max(20_000, int(10 * sum(n * many for n, many in by_count) ** 0.5))
    held, above = 0, 0
    for n, many in by_count:
        if (held := held + many) > most:
            above = n
            break
    words = counts.where(F.col("n") > above).collect()
    groups = max(1, most // 4)
    rare = counts.where(F.col("n") <= above).groupBy((F.crc32(F.col("word").cast("binary")) % groups).cast("int"))
    return Words([tuple(w) for w in words], [tuple(r) for r in rare.agg(F.sum("n"), F.count("*")).collect()], groups)


def huffman(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Paths of all leaves one after another (inner nodes from 0, turns -1 or 1), where each begins, and the nodes' constants."""
    n = len(counts)
    order = np.argsort(counts, kind="stable").tolist()
    mass, parent, turn, bias = counts.tolist() + [0.0] * max(0, n - 1), np.full(2 * n - 1 if n else 0, -1), np.zeros(2 * n, np.int8), []
    leaf, inner = 0, n
    for new in range(n, 2 * n - 1):
        pair = []
        for _ in range(2):  # the lighter of the next leaf and the next inner node
            if leaf < n and (inner >= new or mass[order[leaf]] <= mass[inner]):
                pair.append(order[leaf])
                leaf += 1
            else:
                pair.append(inner)
                inner += 1
        mass[new] = mass[pair[0]] + mass[pair[1]]
        parent[pair], turn[pair[0]], turn[pair[1]] = new, -1, 1
        bias.append(np.log(mass[pair[1]] / mass[pair[0]]))
    at, who, owners, nodes, turns = np.arange(n), np.arange(n), [], [], []
    while len(keep := np.flatnonzero(parent[at] >= 0)):
        at, who = at[keep], who[keep]
        owners.append(who)
        nodes.append(parent[at] - n)
        turns.append(turn[at])
        at = parent[at]
    if not owners:
        return np.zeros(0, np.int32), np.zeros(0, np.float32), np.zeros(n + 1, np.int64), np.zeros(0, np.float32)
    owner = np.concatenate(owners)
    by = np.argsort(owner, kind="stable")
    begins = np.searchsorted(owner[by], np.arange(n + 1))
    return np.concatenate(nodes)[by].astype(np.int32), np.concatenate(turns)[by].astype(np.float32), begins, np.array(bias, np.float32)


def summed(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different ``rows`` and the sums of their values."""
    if not len(rows):
        return rows, values
    order = np.argsort(rows, kind="stable")
    sorted_rows = rows[order]
    first = np.flatnonzero(np.append(True, sorted_rows[1:] != sorted_rows[:-1]))
    return sorted_rows[first], np.add.reduceat(values.T[:, order], first, axis=1).T if values.ndim > 1 else np.add.reduceat(values[order], first)


class Network:
    def __init__(self, inputs: int, counts: np.ndarray, width: int, hidden: int, seed: int = 5) -> None:
        """``inputs`` different marks around, the edge among them; ``counts`` of the leaves."""
        rng = np.random.RandomState(seed)
        self.nodes, self.turns, self.begins, bias = huffman(counts)
        scale = lambda *shape: (rng.normal(0, 1, shape) / np.sqrt(shape[0])).astype(np.float32)
        embedding = rng.uniform(-0.5, 0.5, (inputs, width)).astype(np.float32)
        fan = len(PLACES) * width
        self.params = [embedding, scale(fan, hidden), np.zeros(hidden, np.float32), np.zeros((len(bias), hidden), np.float32), bias]

    def forward(self, around: np.ndarray, leaf: np.ndarray):
        """The layers and the visits of nodes: the window and the node of each, whether it is one of the ``TOP`` heaviest, and its value."""
        embedding, inner, shift, vectors, bias = self.params
        x = embedding.take(around, 0).reshape(len(around), -1)
        h = np.tanh(x @ inner + shift)
        sizes = self.begins[leaf + 1] - self.begins[leaf]
        first = np.cumsum(sizes) - sizes
        own = np.repeat(np.arange(len(leaf)), sizes)
        at = np.arange(len(own)) + (self.begins[leaf] - first)[own]
        node, turn = self.nodes.take(at), self.turns.take(at)
        heavy = max(0, len(bias) - TOP)  # nodes are numbered from light to heavy; most visits are of few nodes
        top = node >= heavy
        z = bias.take(node)
        z[top] += (h @ vectors[heavy:].T)[own[top], node[top] - heavy]
        z[~top] += np.einsum("ij,ij->i", h.take(own[~top], 0), vectors.take(node[~top], 0))
        return x, h, first, own, node, heavy, top, turn, z

    def log_prob(self, around: np.ndarray, leaf: np.ndarray, part: int = 2048) -> np.ndarray:
        """log P(leaf | leaves around) of each row."""
        out = np.zeros(len(leaf))
        if not len(self.params[-1]):  # a single leaf is certain
            return out
        for at in range(0, len(leaf), part):
            _, _, first, *_, turn, z = self.forward(around[at : at + part], leaf[at : at + part])
            wrong = -turn * z
            each = np.maximum(wrong, 0) + np.log1p(np.exp(-np.abs(wrong)))
            out[at : at + part] = -np.add.reduceat(each, first, dtype=np.float64)
        return out

    def copied(self) -> Network:
        """A network with parameters and squared gradients of its own over the same tree."""
        other = copy(self)
        other.params, other.seen = ([p.copy() for p in v] for v in (self.params, self.seen))
        return other

    def start(self) -> None:
        self.seen = [np.full_like(p, 1e-6) for p in self.params]

    def learn(self, around: np.ndarray, leaf: np.ndarray, weight: np.ndarray | None = None, rate: float = 0.2) -> None:
        """One step down the gradient of the mean over the windows."""
        embedding, inner, _, vectors, bias = self.params
        if not len(bias) or not len(leaf):
            return
        x, h, _, own, node, heavy, top, turn, z = self.forward(around, leaf)
        pull = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - (turn > 0)
        pull = (pull * (weight[own] if weight is not None else 1) / len(leaf)).astype(np.float32)
        dense = np.zeros((len(leaf), len(bias) - heavy), np.float32)
        dense[own[top], node[top] - heavy] = pull[top]
        back = dense @ vectors[heavy:]
        own, node, pull = own[~top], node[~top], pull[~top]
        if len(own):
            begin = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            back[own[begin]] += np.add.reduceat(pull[:, None] * vectors.take(node, 0), begin)
        back *= 1 - h**2
        nodes, of_nodes = summed(node, pull[:, None] * np.concatenate((h, np.ones((len(h), 1), np.float32)), 1).take(own, 0))
        marks, of_marks = summed(around.ravel(), (back @ inner.T).reshape(-1, embedding.shape[1]))
        heaviest, all_of = slice(heavy, None), slice(None)
        steps = [
            (0, marks, of_marks), (1, all_of, x.T @ back), (2, all_of, back.sum(0)), (3, heaviest, dense.T @ h), (4, heaviest, dense.sum(0)),
            (3, nodes, of_nodes[:, :-1]), (4, nodes, of_nodes[:, -1]),
        ]
        for which, rows, step in steps:
            now = self.seen[which][rows] + step**2
            self.seen[which][rows] = now
            self.params[which][rows] -= rate * step / np.sqrt(now)


def train(cell: np.ndarray, n: np.ndarray, inputs: int, outputs: int, width: int = 12, hidden: int = 16, epochs: int = 25) -> np.ndarray:
    """log P(class | window) of every window of ``inputs`` marks and an edge, learned from counted cells window * outputs + class.

    The network of ``score`` over few classes, so that its whole distribution can be written down.
    """
    many, places = inputs + 1, len(PLACES)
    digits = lambda windows: np.stack([windows // many ** (places - 1 - k) % many for k in range(places)], 1)
    network = Network(many, np.bincount(cell % outputs, n, outputs) + 1, width, hidden)
    network.start()
    for _ in range(epochs):
        for at in range(0, len(cell), BATCH):
            part = cell[at : at + BATCH]
            network.learn(digits(part // outputs), part % outputs, n[at : at + BATCH] / n.mean())
    everything = np.arange(many**places * outputs)
    return network.log_prob(digits(everything // outputs), everything % outputs).reshape(-1, outputs)


WINDOW = [*(f"w{k}" for k in range(len(PLACES))), "leaf"]


def windows(words: Words, texts: list[bytes | None], every: int) -> np.ndarray:
    """One of ``every`` windows of the texts: the leaves around, then the leaf."""
    ids, place, sizes = words.tokens(texts)
    hit = np.arange(len(ids))
    if every > 1:
        key = np.repeat(np.array([zlib.crc32(t or b"") for t in texts], np.uint64), sizes) << np.uint64(32) | place.astype(np.uint64)
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            key = (key ^ key >> np.uint64(shift)) * np.uint64(by)
        key ^= key >> np.uint64(31)
        hit = np.flatnonzero(key % np.uint64(every) == 0)
    return np.concatenate((words.around(ids, place, sizes, hit), ids[hit, None]), 1)


def found_in(words: Words, batches: Iterable[pa.RecordBatch], every: int, texts: int = 1024) -> Iterator[np.ndarray]:
    for batch in batches:
        for at in range(0, batch.num_rows, texts):
            yield windows(words, utf8(batch.column("text").slice(at, texts)), every)


def windows_of(docs: DataFrame, sent, every: int) -> DataFrame:
    """The windows that ``learn`` learns from; ``sent`` holds a pair whose first is the words."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in found_in(sent.value[0], batches, every):
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in found.T], names=WINDOW)

    return docs.select("text").mapInArrow(pick, ", ".join(f"{c} int" for c in WINDOW))


def steps_of(found: Iterable[np.ndarray]) -> Iterator[np.ndarray]:
    """Windows in steps of ``BATCH``, the last one smaller; those of ``MIXED`` steps are shuffled, alike in every run."""
    rng, held, size = np.random.RandomState(7), [], BATCH * MIXED

    def steps(run: np.ndarray) -> Iterator[np.ndarray]:
        run = run[rng.permutation(len(run))]
        yield from (run[at : at + BATCH] for at in range(0, len(run), BATCH))

    for part in found:
        held.append(part)
        if sum(map(len, held)) >= size:
            whole = np.concatenate(held)
            for at in range(0, len(whole) - size + 1, size):
                yield from steps(whole[at : at + size])
            held = [whole[len(whole) - len(whole) % size :]]
    if held and sum(map(len, held)):
        yield from steps(np.concatenate(held))


def learn(docs: DataFrame, words: Words, network: Network, every: int, block: int) -> Network:
    """Train ``network`` on a share of the documents, then mix copies of it that are trained on parts of the others."""
    many = float(words.counts.sum()) / every
    shares = max(1, round(many / block))
    context = docs.sparkSession.sparkContext
    texts = docs.select("text", F.xxhash64("doc_id", "text").alias("turn"))
    first = F.pmod("turn", F.lit(shares)) == 0
    sent = context.broadcast((words, network))
    network = mixed(texts.where(first).repartition(1), sent, network, every)
    if shares > 1:
        sent = context.broadcast((words, network))
        parts = max(1, round(many / max(block, 40 * len(network.begins))))
        network = mixed(texts.where(~first).repartition(parts, "turn"), sent, network, every)
    return network


def mixed(texts: DataFrame, sent, network: Network, every: int, piece: int = 1 << 14) -> Network:
    """The mean of copies of ``network`` (the second of ``sent``), each trained on the windows of a partition of ``texts`` (text, turn)."""
    again = F.row_number().over(Window.partitionBy("turn").orderBy("text"))  # so that copies of a row are not learned one after the other
    turn = texts.withColumn("again", F.xxhash64("turn", again)).sortWithinPartitions("again", "text").select("text")
    kinds, names = "which int, piece int, rows binary, met binary, change binary", ["which", "piece", "rows", "met", "change"]

    def packed(which: int, part: int, rows: np.ndarray, met: np.ndarray, change: np.ndarray) -> pa.RecordBatch:
        each = [pa.array([v.tobytes()], pa.binary()) for v in (rows.astype(np.int32), met, change)]
        return pa.RecordBatch.from_arrays([*(pa.array([v], pa.int32()) for v in (which, part)), *each], names=names)

    def train_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (words, start), own = sent.value, None
        for step in steps_of(found_in(words, batches, every)):
            own = own or start.copied()
            own.learn(step[:, :-1], step[:, -1])
        for which in range(len(start.params) if own else 0):
            p, old, seen, before = (v[which].reshape(len(v[which]), -1) for v in (own.params, start.params, own.seen, start.seen))
            met = (seen - before).sum(1)
            for part in range(-(-len(p) // piece)):
                rows = part * piece + np.flatnonzero(met[part * piece : (part + 1) * piece])
                if len(rows):
                    yield packed(which, part, rows, met[rows], (p[rows] - old[rows]).astype(np.float16))

    def mix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, met, change = None, None, None

        def out() -> pa.RecordBatch:
            rows = np.flatnonzero(met)
            return packed(*now, now[1] * piece + rows, met[rows].astype(np.float32), (change[rows] / met[rows, None]).astype(np.float32))

        for batch in batches:
            for values in zip(*batch.columns, strict=True):
                which, part, *packs = (v.as_py() for v in values)
                rows, weights, moves = (np.frombuffer(v, kind) for v, kind in zip(packs, (np.int32, np.float32, np.float16), strict=True))
                if now != (which, part):
                    if now:
                        yield out()
                    now, met, change = (which, part), np.zeros(piece), np.zeros((piece, len(moves) // len(rows)))
                rows = rows - part * piece
                met[rows] += weights
                change[rows] += weights[:, None] * moves.reshape(len(rows), -1)
        if now:
            yield out()

    copies = turn.mapInArrow(train_part, kinds).repartition("which", "piece").sortWithinPartitions("which", "piece", "met", "rows")
    new = network.copied()
    for row in copies.mapInArrow(mix, kinds).toArrow().to_pylist():
        rows, met, change = (np.frombuffer(row[c], kind) for c, kind in (("rows", np.int32), ("met", np.float32), ("change", np.float32)))
        p = new.params[row["which"]]
        p[rows] += change.reshape(-1, *p.shape[1:])
        seen = new.seen[row["which"]]
        seen[rows] += (met / max(1, seen[:1].size)).reshape(-1, *[1] * (seen.ndim - 1))  # spread over the row
    return new


def score(docs: DataFrame, vocabulary: int | None = None, width: int = 12, hidden: int = 16, every: int = 1, block: int = 500_000) -> DataFrame:
    """doc_id, n_tokens, log_prob and score of every row of ``docs``."""
    words = learn_words(docs, vocabulary)
    network = Network(len(words.counts) + 1, words.counts, width, hidden)
    network.start()
    network = learn(docs, words, network, every, block)
    del network.seen
    sent = docs.sparkSession.sparkContext.broadcast((words, network))

    def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        known, model = sent.value
        ids, place, sizes = known.tokens(utf8(batch.column("text")))
        each = model.log_prob(known.around(ids, place, sizes, np.arange(len(ids))), ids) + known.within[ids]
        total = np.bincount(np.repeat(np.arange(len(sizes)), sizes), each, len(sizes))
        return {
            "n_tokens": pa.array(sizes),
            "log_prob": pa.array(total),
            "score": pa.array(total / np.maximum(sizes, 1), mask=sizes == 0),
        }

    fields = [("n_tokens", T.LongType()), ("log_prob", T.DoubleType()), ("score", T.DoubleType())]
    return map_rows(docs.select("doc_id", "text"), work, fields, ["doc_id"])


def op9_masked_lm(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
