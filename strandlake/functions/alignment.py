"""Gapped local alignment of pairs of sequences, on a band around an expected diagonal or over the whole matrix.

Pairs are aligned in batches, row by row of the matrix: one numpy step does a row of all pairs of a batch.  Along a row a gap can be chained, so
a row's scores are a running maximum of (score + gap * column) less gap * column.  Memory holds two rows of a batch and a
kept row every ``EVERY`` rows; the path of the best alignment is found by recomputing the stretches between kept rows, from the last
one back.  So a pair of a million letters on a band of 100 takes a few MB.

Fixed values: match 1, mismatch -2, gap -4; N against anything 0, X a mismatch even with itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MATCH, MISMATCH, GAP = 1, -2, -4
#: Cells of a batch's rows, rows between kept ones, and letters of a batch if all pairs were as long as the longest.
CELLS, EVERY, LETTERS = 1 << 16, 512, 1 << 24


def pair_scores() -> np.ndarray:
    """Score of two letters by their codes; code 0 stands for outside."""
    out = np.full((128, 128), MISMATCH, np.int32)
    np.fill_diagonal(out, MATCH)
    for code, score in ((ord("X"), MISMATCH), (ord("N"), 0)):
        out[code, :] = out[:, code] = score
    return out


SCORES = pair_scores()


def codes(text: str) -> np.ndarray:
    """Codes of upper-case letters; other characters than ASCII match nothing but themselves as one class."""
    return np.minimum(np.frombuffer(text.upper().encode("latin-1", "replace"), np.uint8), 127)


class Matrix:
    """Rows of the matrices of several pairs (a, b).

    With a band, column j of a row stands for letter row - move + j - band of b (from 0), where a = b + move on the expected diagonal;
    without, for letter j.
    """

    def __init__(self, a: list[np.ndarray], b: list[np.ndarray], moves: list[int], band: int | None) -> None:
        self.band, self.n = band, len(a)
        self.a_sizes, self.b_sizes = np.array([len(x) for x in a]), np.array([len(x) for x in b])
        self.width = max(int(self.b_sizes.max(initial=0)), 1) if band is None else 2 * band + 1
        moves_ = np.array(moves, dtype=np.int64)
        #: Letter of b (from 0) in column 0 of row 0.
        self.start = np.zeros(self.n, np.int64) if band is None else -moves_ - band
        low, high = self.start, self.a_sizes + self.b_sizes
        self.first = np.zeros(self.n, np.int64) if band is None else np.maximum(0, -low - self.width + 1)
        self.last = self.a_sizes if band is None else np.minimum(self.a_sizes, self.b_sizes - low)
        self.last = np.minimum(np.maximum(self.last, self.first), high)
        self.a = np.zeros((self.n, int(self.a_sizes.max(initial=0))), np.uint8)
        self.b = np.zeros((self.n, int(self.b_sizes.max(initial=0)) + 1), np.uint8)
        for k in range(self.n):
            self.a[k, : len(a[k])], self.b[k, : len(b[k])] = a[k], b[k]
        self.steps = np.arange(self.width)

    def rows(self) -> int:
        return int((self.last - self.first).max(initial=0))

    def next(self, before: np.ndarray, row: int, only: slice = slice(None)) -> np.ndarray:
        """Scores of row ``row`` (counted from each pair's first) after those of the row before."""
        at = self.first[only] + row
        column = self.start[only][:, None] + self.steps + (0 if self.band is None else at[:, None])
        size = self.b_sizes[only]
        inside = (column >= 0) & (column < size[:, None]) & (at < self.last[only])[:, None]
        letters = np.take_along_axis(self.b[only], np.where(inside, column, size[:, None]), 1)
        mine = np.take_along_axis(self.a[only], np.minimum(at, self.a.shape[1] - 1)[:, None], 1)
        score, edge = SCORES[mine, letters], np.zeros((len(before), 1), before.dtype)
        if self.band is None:
            diagonal, up = np.hstack([edge, before[:, :-1]]), before
        else:
            diagonal, up = before, np.hstack([before[:, 1:], edge])
        best = np.maximum(np.maximum(diagonal + score, up + GAP), 0) * inside
        return (np.maximum.accumulate(best - GAP * self.steps, axis=1) + GAP * self.steps) * inside

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """Score, row and column of the first best cell of every pair, and the rows kept (row -1, then every EVERY-th)."""
        now = np.zeros((self.n, self.width), np.int32)
        score, row_of, column_of, kept = np.zeros(self.n, np.int32), np.zeros(self.n, np.int64), np.zeros(self.n, np.int64), []
        reach = np.maximum.accumulate((self.last - self.first)[::-1])[::-1]
        for row in range(self.rows()):
            only = slice(0, int(np.searchsorted(-reach, -row)))  # pairs that end here or before, after all others, are left out
            now = now[only]
            if row % EVERY == 0:
                kept.append(now)
            now = self.next(now, row, only)
            column = now.argmax(1)
            top = now[np.arange(len(now)), column]
            better = np.flatnonzero(top > score[only])
            score[better], row_of[better], column_of[better] = top[better], row, column[better]
        return score, row_of, column_of, kept

    def runs(self, k: int, row: int, column: int, kept: list[np.ndarray]) -> list[tuple[int, int, int, int]]:
        """Runs of equal letters (first and last of a, first and last of b, from 1) on the path that ends in the cell, in order.

        From a cell the diagonal is taken if it is as good as a gap, a gap in b only if it is better than one in a.
        """
        only, out, held, begin = slice(k, k + 1), [], None, None
        while row >= 0:
            if held is None or row < begin:
                begin = row // EVERY * EVERY
                held = [kept[row // EVERY][k]]
                for r in range(begin, row + 1):
                    held.append(self.next(held[-1][None], r, only)[0])
            own, above = held[row - begin + 1], held[row - begin]
            if own[column] <= 0:
                break
            at = int(self.first[k]) + row
            there = int(self.start[k]) + column + (0 if self.band is None else at)
            x, y = self.a[k, at], self.b[k, there]
            back = column - 1 if self.band is None else column
            over = column if self.band is None else column + 1
            value = lambda line, c: int(line[c]) if 0 <= c < self.width else 0
            diagonal, up, left = value(above, back) + int(SCORES[x, y]), value(above, over) + GAP, value(own, column - 1) + GAP
            if x == y and out and out[-1][4] and (out[-1][0], out[-1][2]) == (at + 2, there + 2):
                out[-1][0], out[-1][2] = at + 1, there + 1
            elif x == y:
                out.append([at + 1, at + 1, there + 1, there + 1, True])
            elif out:
                out[-1][4] = False
            if diagonal >= max(up, left):
                row, column = row - 1, back
            elif up > left:
                row, column = row - 1, over
            else:
                column -= 1
            if column < 0:
                break
        return [tuple(r[:4]) for r in reversed(out)]


def aligned(pairs: DataFrame, band: int | None = None, segments: bool = False) -> DataFrame:
    """``pairs`` (a, b, move, ...) without a and b, with score, a_last, b_last (the best cell, from 1; null if the score is 0) and, if asked for,
    ``runs``: an array of (a_first, a_last, b_first, b_last) of equal letters along the best alignment.

    The band covers ``band`` diagonals to both sides of a = b + move; without one the whole matrix is searched.  The first of equally good cells counts, by a and
    then b.  A null or empty sequence scores 0.
    """
    rest = [c for c in pairs.columns if c not in ("a", "b")]
    run = T.StructType([T.StructField(c, T.LongType()) for c in ("a_first", "a_last", "b_first", "b_last")])
    fields = [T.StructField("score", T.LongType()), T.StructField("a_end", T.LongType()), T.StructField("b_end", T.LongType())]
    fields += [T.StructField("runs", T.ArrayType(run))] if segments else []
    schema = T.StructType([pairs.schema[c] for c in rest] + fields)

    def solved(part: pa.RecordBatch) -> pa.RecordBatch:
        column = {c: part.column(part.schema.get_field_index(c)) for c in (*rest, "a", "b", "move")}
        a, b = ([codes(x or "") for x in column[c].to_pylist()] for c in ("a", "b"))
        matrix = Matrix(a, b, [m or 0 for m in column["move"].to_pylist()], band)
        score, row, col, kept = matrix.best()
        at = matrix.first + row
        there = matrix.start + col + (0 if band is None else at)
        none = score == 0
        found = [pa.array(score.astype(np.int64)), pa.array(at + 1, mask=none), pa.array(there + 1, mask=none)]
        if segments:
            names = run.names
            found.append(pa.array([[dict(zip(names, map(int, r))) for r in matrix.runs(k, int(row[k]), int(col[k]), kept)] if score[k] else [] for k in range(matrix.n)],
                                  pa.list_(pa.struct([(n, pa.int64()) for n in names]))))
        return pa.RecordBatch.from_arrays([column[c] for c in rest] + found, names=schema.names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, sizes = (np.array([len(x or "") for x in batch.column(batch.schema.get_field_index(c)).to_pylist()], np.int64) for c in ("a", "b"))
            order = np.argsort(-(np.minimum(first, sizes) if band is not None else first), kind="stable")  # pairs of like length take their steps together
            batch, first, sizes = batch.take(pa.array(order)), first[order], sizes[order]
            at = 0
            while at < batch.num_rows:
                end, widest, longest = at, 0, 0
                while end < batch.num_rows:
                    widest = max(widest, 2 * band + 1 if band is not None else max(int(sizes[end]), 1))
                    longest = max(longest, int(first[end]), int(sizes[end]))
                    if end > at and ((end - at + 1) * widest > CELLS or (end - at + 1) * longest > LETTERS):
                        break
                    end += 1
                yield solved(batch.slice(at, end - at))
                at = end

    return pairs.mapInArrow(work, schema)


def oriented(pairs: DataFrame, sequences: DataFrame, reverse) -> DataFrame:
    """``pairs`` (seq_a, seq_b, dir, shift, ...) with a, b (turned if dir is -1) and move, so that a = b + move."""
    text = lambda name, to: sequences.select(F.col("seq_id").alias(name), F.upper("dna").alias(to))
    at = pairs.join(text("seq_a", "a"), "seq_a").join(text("seq_b", "b"), "seq_b")
    move = F.when(F.col("dir") == 1, F.col("shift")).otherwise(F.col("shift") - F.length("b") - 1).alias("move")
    return at.select(*pairs.columns, "a", F.when(F.col("dir") == 1, F.col("b")).otherwise(reverse("b")).alias("b"), move)
