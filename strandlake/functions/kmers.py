"""k-mers, overlaps and oligos over sequences (seq_id, dna).

Sequences are cut into chunks that overlap by a k-mer, so a long one is read by expressions over short strings, or by numpy in pieces.

Common k-mers of a pair at one offset stand in runs.  ``breaks`` makes rows of the ends of runs only: two places of a k-mer meet if the letters before
(or after) them differ, so a stretch of L common k-mers is two rows, not L, and places inside of common stretches never meet.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.functions.sequences import oligo_pattern, reverse_complement, scanned
from strandlake.operators.components import settled

CHUNK = 500
PAIR = ["seq_a", "seq_b", "dir"]
#: Letters that numpy reads at once.
PIECE = 1 << 18
#: Two bits a base, by code; 4 for all else.
CODES = np.full(256, 4, np.uint8)
CODES[list(b"ACGT")] = range(4)


def windows(sequences: DataFrame, k: int) -> DataFrame:
    """seq_id, pos (of the first base, from 1), kmer, in upper case, of every window, whatever its letters."""
    many = F.floor((F.length("dna") - 1) / CHUNK).cast("int")
    chunks = sequences.where(F.length("dna") >= k).select("seq_id", F.upper("dna").alias("dna"), F.explode(F.sequence(F.lit(0), many)).alias("c"))
    part = F.substring("dna", F.col("c") * CHUNK + 1, F.lit(CHUNK + k - 1))
    parts = chunks.select("seq_id", (F.col("c") * CHUNK).alias("before"), part.alias("part")).where(F.length("part") >= k)
    each = parts.select("seq_id", "before", "part", F.explode(F.sequence(F.lit(1), F.length("part") - k + 1)).alias("i"))
    return each.select("seq_id", (F.col("before") + F.col("i")).cast("long").alias("pos"), F.substring("part", F.col("i"), F.lit(k)).alias("kmer"))


def index(sequences: DataFrame, k: int) -> DataFrame:
    """seq_id, centre, kmer of the windows of an odd length that hold bases only."""
    if k % 2 == 0:
        raise ValueError("k must be odd")
    return windows(sequences, k).where(F.translate("kmer", "ACGT", "") == "").select("seq_id", (F.col("pos") + k // 2).alias("centre"), "kmer")


def accepted(sequences: DataFrame, k: int) -> DataFrame:
    """seq_id, accepted, rejected windows."""
    good = F.translate("kmer", "ACGT", "") == ""
    return windows(sequences, k).groupBy("seq_id").agg(F.count_if(good).alias("accepted"), F.count_if(~good).alias("rejected"))


class Windows(NamedTuple):
    """Windows of bases only: which of ``ids`` (and ``sizes`` of the whole sequences), place of the first base (from 1), letters in two bits each,
    those of the other strand, and the letters before and after (4: none, or no base)."""

    ids: list
    sizes: np.ndarray
    which: np.ndarray
    pos: np.ndarray
    code: np.ndarray
    other: np.ndarray
    before: np.ndarray
    after: np.ndarray


def rolled(letters: np.ndarray, k: int) -> np.ndarray:
    """The number that each ``k`` neighbours make, two bits a letter."""
    width, part, have, out = 1, letters.astype(np.int64), 0, None
    while True:
        if k & width:
            many = len(letters) - have - width + 1
            out = part if out is None else out[:many] << 2 * width | part[have : have + many]
            have += width
        if have == k:
            return out
        part, width = part[:-width] << 2 * width | part[width:], 2 * width


def windows_of(pieces: list[tuple], k: int) -> Windows:
    """Windows of pieces (seq_id, size of the sequence, place of the piece, its letters with one more before and k after)."""
    ids, sizes, starts, texts = zip(*pieces)
    letters = CODES[np.frombuffer(b"\n" * (k + 1) + b"\n".join(texts) + b"\n" * (k + 1), np.uint8)]
    lengths, starts = np.array([len(t) for t in texts]), np.array(starts)
    first = k + 1 + np.cumsum(lengths + 1) - (lengths + 1)
    bad = np.append(0, np.cumsum(letters > 3))
    at = np.flatnonzero(bad[k:] == bad[:-k])
    which = np.searchsorted(first, at, "right") - 1
    place = starts[which] + at - first[which] - (starts[which] > 0)
    own = (place >= starts[which]) & (place < starts[which] + PIECE)
    at, which, place = at[own], which[own], place[own]
    base = letters & 3
    return Windows(list(ids), np.array(sizes), which, place + 1, rolled(base, k)[at], rolled(3 - base[::-1], k)[::-1][at], letters[at - 1], letters[at + k])


def read_pieces(rows: Iterable[tuple], k: int) -> Iterator[list[tuple]]:
    """What ``windows_of`` takes, about ``PIECE`` letters at a time, of rows (seq_id, dna); a long sequence is cut."""
    held, size = [], 0
    for i, text in rows:
        raw = (text or "").encode("latin-1", "replace")
        for at in range(0, len(raw), PIECE):
            held.append((i, len(raw), at, raw[max(0, at - 1) : at + PIECE + k]))
            if (size := size + len(held[-1][3])) >= PIECE:
                yield held
                held, size = [], 0
    if held:
        yield held


def scanned_windows(sequences: DataFrame, k: int, work, schema: str) -> DataFrame:
    """What ``work`` makes of ``Windows`` of the upper-case sequences; nothing is shuffled."""
    names = [f.split()[0] for f in schema.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in read_pieces(rows(batches), k):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in work(windows_of(held, k))], names=names)

    return sequences.select("seq_id", F.upper("dna").alias("dna")).mapInArrow(run, schema)  # a filter by length would make the letters twice


def ids_of(found: Windows) -> pa.Array:
    return pa.array(found.ids, pa.int64()).take(pa.array(found.which))


def packed(sequences: DataFrame, k: int, ends: int | None = None) -> DataFrame:
    """hash (two bits a base, k < 16), seq_id, pos, in this order; of the whole sequence or of ``ends`` bases at both ends."""
    if not 0 < k < 16:
        raise ValueError("k from 1 to 15")

    def work(found: Windows) -> list:
        columns = [pa.array(found.code), ids_of(found), pa.array(found.pos)]
        if ends is None:
            return columns
        kept = pa.array((found.pos + k - 1 <= ends) | (found.pos > found.sizes[found.which] - ends))
        return [c.filter(kept) for c in columns]

    return scanned_windows(sequences, k, work, "hash long, seq_id long, pos long").orderBy("hash", "seq_id", "pos")


def summed(sequences: DataFrame, k: int) -> DataFrame:
    """seq_id, accepted (windows of bases only), least (the first of their k-mers by letter), last (the largest centre), rejected (other windows).

    Sequences without an accepted window give no row.  ``k`` is odd, 31 at most.
    """
    if k % 2 == 0 or not 0 < k < 32:
        raise ValueError("k must be odd, 31 at most")

    def work(found: Windows) -> list:
        first = np.flatnonzero(np.append(True, found.which[1:] != found.which[:-1])) if len(found.which) else np.zeros(0, np.int64)
        low = np.minimum.reduceat(found.code, first) if len(first) else found.code
        last = np.maximum.reduceat(found.pos, first) if len(first) else found.pos
        which = found.which[first]
        return [pa.array(found.ids, pa.int64()).take(pa.array(which)), pa.array(np.diff(np.append(first, len(found.which)))), pa.array(low),
                pa.array(last + k // 2), pa.array(found.sizes[which].astype(np.int64) - k + 1)]

    parts = scanned_windows(sequences, k, work, "seq_id long, accepted long, low long, last long, windows long")
    whole = parts.groupBy("seq_id").agg(F.sum("accepted").alias("accepted"), F.min("low").alias("low"), F.max("last").alias("last"), F.max("windows").alias("windows"))
    kmer = F.translate(F.lpad(F.conv(F.col("low").cast("string"), 10, 4), k, "0"), "0123", "ACGT")
    return whole.select("seq_id", "accepted", kmer.alias("least"), "last", (F.col("windows") - F.col("accepted")).alias("rejected"))


def places(sequences: DataFrame, k: int) -> DataFrame:
    """seq_id, centre, code, turned, left, right of the windows that hold bases only: the k-mer or, if less (``turned``), that of the other strand as a number,
    and the letters beside it on this strand (4: none, or no base).  ``k`` is odd, 31 at most."""
    if k % 2 == 0 or not 0 < k < 32:
        raise ValueError("k must be odd, 31 at most")

    def work(found: Windows) -> list:
        turned = found.other < found.code
        beside = [np.where(turned, np.where(there < 4, 3 - there.astype(np.int8), 4), here).astype(np.int8)
                  for here, there in ((found.before, found.after), (found.after, found.before))]
        return [ids_of(found), found.pos + k // 2, np.where(turned, found.other, found.code), turned, *beside]

    return scanned_windows(sequences, k, work, "seq_id long, centre long, code long, turned boolean, left byte, right byte")


def placed(indexed: DataFrame) -> DataFrame:
    """``places`` of what ``index`` gives; codes are strings."""
    line = W.partitionBy("seq_id").orderBy("centre")
    before = F.when(F.lag("centre").over(line) == F.col("centre") - 1, F.substring(F.lag("kmer").over(line), 1, 1))
    after = F.when(F.lead("centre").over(line) == F.col("centre") + 1, F.substring(F.lead("kmer").over(line), -1, 1))
    number = lambda c, letters: F.coalesce(F.position(c, F.lit(letters)) - 1, F.lit(4)).cast("byte")
    found = indexed.select("seq_id", "centre", "kmer", before.alias("before"), after.alias("after"), reverse_complement("kmer").alias("other"))
    beside = [F.when(F.col("turned"), number(F.col(there), "TGCA")).otherwise(number(F.col(here), "ACGT")).alias(to) for here, there, to in (("before", "after", "left"), ("after", "before", "right"))]
    return found.withColumn("turned", F.col("other") < F.col("kmer")).select("seq_id", "centre", F.least("kmer", "other").alias("code"), "turned", *beside)


def breaks(found: DataFrame, few: int = 32, block: int = 4096) -> DataFrame:
    """seq_a < seq_b, dir, shift, centre (in a), last: a row per first and per last k-mer of every run of ``hits`` of a pair.

    Only places of k-mers in several sequences meet.  Those of a k-mer in more than ``few`` places carry the letters beside them in the key, so that pairs inside of
    runs don't meet at all; in more than ``block``, they are dealt to blocks, and each pair of blocks is a key of its own.  A sequence that stands for ``copies``
    (``marked``) meets itself too, and the rows say that it does.
    """
    same, own = W.partitionBy("code"), ["copies"] if "copies" in found.columns else []
    some = found.withColumns({"many": F.count("*").over(same), "low": F.min("seq_id").over(same), "high": F.max("seq_id").over(same)}).where(" or ".join(["low < high", *own]))
    some = settled(some.select("seq_id", "centre", "code", "turned", "left", "right", "many", *own))
    pairs = "seq_a < seq_b or (seq_a = seq_b and copies)" if own else "seq_a < seq_b"
    named = lambda rows, seq, place, turned, *rest: rows.select("code", F.col("seq_id").alias(seq), F.col("centre").alias(place), F.col("turned").alias(turned), *rest)
    rare, apart = some.where(F.col("many") <= few), lambda c: (F.col(c) != F.col(f"{c}_b")) | (F.col(c) == 4)
    met = named(rare, "seq_a", "centre", "turned", "left", "right", *own).join(named(rare, "seq_b", "other", "back", F.col("left").alias("left_b"), F.col("right").alias("right_b")), "code")
    sides = F.filter(F.array(F.when(apart("left"), False), F.when(apart("right"), True)), lambda side: side.isNotNull())
    columns = ["seq_a", "seq_b", "centre", "other", "turned", "back", "side", *own]
    met = met.where(pairs).where(apart("left") | apart("right")).withColumn("side", F.explode(sides)).select(columns)

    each = some.where(F.col("many") > few).withColumn("m", F.ceil(F.col("many") / block).cast("int"))
    sides = F.array(*(F.struct(F.lit(side).alias("side"), F.col(c).alias("x")) for side, c in ((False, "left"), (True, "right"))))
    each = each.withColumns({"own": F.pmod(F.xxhash64("seq_id", "centre"), F.col("m")).cast("int"), "met": F.explode(F.sequence(F.lit(0), F.col("m") - 1))}).select("*", F.inline(sides))
    others = F.filter(F.array(*(F.lit(n).cast("byte") for n in range(5))), lambda n: (n != F.col("x")) | (n == 4))  # ends of sequences differ from all
    a = named(each, "seq_a", "centre", "turned", "side", "x", F.col("own").alias("i"), F.col("met").alias("j"), *own)
    b = named(each, "seq_b", "other", "back", "side", F.explode(others).alias("x"), F.col("met").alias("i"), F.col("own").alias("j"))
    met = met.unionByName(a.join(b, ["code", "side", "x", "i", "j"]).where(pairs).select(columns))

    alike = F.col("turned") == F.col("back")
    shift = F.when(alike, F.col("centre") - F.col("other")).otherwise(F.col("centre") + F.col("other"))
    return met.select("seq_a", "seq_b", F.when(alike, 1).otherwise(-1).alias("dir"), shift.alias("shift"), "centre", (F.col("side") != F.col("turned")).alias("last"), *own)


def ends_of(indexed: DataFrame) -> DataFrame:
    return breaks(indexed if "code" in indexed.columns else placed(indexed))


def representatives(sequences: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first of equal sequences each, and (seq_id, like): which one stands for every sequence."""
    keyed = sequences.withColumn("key", F.md5(F.upper("dna")))
    first = keyed.groupBy("key").agg(F.min("seq_id").alias("like"))
    member = keyed.select("seq_id", "key").join(first, "key").select("seq_id", "like")
    return sequences.join(first.select(F.col("like").alias("seq_id")), "seq_id", "left_semi"), member


def marked(first: DataFrame, member: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``first`` of ``representatives`` with ``copies``, and (like, members) of those that stand for several sequences, all members with them."""
    several = settled(member.groupBy("like").agg(F.collect_list("seq_id").alias("members")).where(F.size("members") > 1))
    mine = several.select(F.col("like").alias("seq_id"), F.lit(True).alias("copies"))
    return first.join(mine, "seq_id", "left").withColumn("copies", F.coalesce("copies", F.lit(False))), several


def marked_places(sequences: DataFrame, k: int) -> DataFrame:
    """``places`` of ``marked`` sequences, with ``copies``."""
    odd = F.shiftleft("seq_id", 1).bitwiseOR(F.col("copies").cast("long"))  # travels in the id, as letters are read with nothing beside
    found = places(sequences.select(odd.alias("seq_id"), "dna"), k)
    return found.withColumns({"copies": F.col("seq_id").bitwiseAND(F.lit(1)) == 1, "seq_id": F.shiftright("seq_id", 1)})


def spread(found: DataFrame, several: DataFrame, turned: dict[str, Column] | None = None) -> DataFrame:
    """Rows of pairs of representatives for every pair of sequences that they stand for; ``several`` as ``marked`` gives it.

    ``turned`` gives the columns of a row whose sequences change places.  Without it rows stand for pairs in their own order only, so both orders of a pair have rows of their own.
    """
    for side in ("seq_a", "seq_b"):
        theirs = several.select(F.col("like").alias(side), F.col("members").alias(f"{side}_all"))
        found = found.join(theirs, side, "left")
    rest = [c for c in found.columns if c not in ("seq_a", "seq_b", "seq_a_all", "seq_b_all")]
    pairs = found.withColumn("same", F.col("seq_a") == F.col("seq_b")).select("same", F.explode(F.coalesce("seq_a_all", F.array("seq_a"))).alias("seq_a"), "seq_b", "seq_b_all", *rest)
    pairs = pairs.select("same", "seq_a", F.explode(F.coalesce("seq_b_all", F.array("seq_b"))).alias("seq_b"), *rest)
    if turned is None:
        return pairs.where("seq_a < seq_b").select("seq_a", "seq_b", *rest)
    back = F.col("seq_a") > F.col("seq_b")
    changed = {c: F.when(back, v).otherwise(F.col(c)) for c, v in turned.items()}
    pairs = pairs.where("seq_a < seq_b or (seq_a > seq_b and not same)").withColumns(changed)
    return pairs.select(F.least("seq_a", "seq_b").alias("seq_a"), F.greatest("seq_a", "seq_b").alias("seq_b"), *rest)


def of_members(counted: DataFrame, several: DataFrame) -> DataFrame:
    """``offsets`` of representatives as those of all sequences."""
    return spread(counted, several, {"shift": F.when(F.col("dir") == 1, -F.col("shift")).otherwise(F.col("shift"))}).select(*PAIR, "shift", "n")


def offsets(indexed: DataFrame, least: int = 1, most: int | None = None, **limits) -> DataFrame:
    """seq_a < seq_b, dir, shift, n: common k-mers of each pair by offset, p - q if dir is 1, p + q against the complement if -1.

    ``indexed`` is what ``places`` or ``index`` gives, ``index`` if there are limits.  ``most`` leaves k-mers out that stand in more places, as a guard for
    repeats; without it every common k-mer counts.  ``limits``: see ``hits``.
    """
    if most is not None:
        indexed = indexed.join(indexed.groupBy("kmer").agg(F.count("*").alias("many")).where(F.col("many") <= most).select("kmer"), "kmer", "left_semi")
    if limits:
        return hits(indexed, **limits).groupBy(*PAIR, "shift").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    size = F.when(F.col("last"), F.col("centre") + 1).otherwise(-F.col("centre"))  # both ends of a run together make its length
    return ends_of(indexed).groupBy(*PAIR, "shift").agg(F.sum(size).alias("n")).where(F.col("n") >= least)


def hits(
    indexed: DataFrame, block: int = 4096, band: tuple[float, float, float] | None = None, shifts: tuple[int, int] | None = None
) -> DataFrame:
    """seq_a, seq_b, dir, shift, centre (in a): a row per common k-mer of a pair.

    ``band`` = (linear, constant, window) keeps places q of b within ``window`` of linear * p + constant, so in the direction that
    ``linear`` has; ``shifts`` keeps offsets between two bounds, both included.  A k-mer in more than ``block`` places is dealt to blocks, and
    every pair of its blocks is a key of its own: no task gets all places of a k-mer, and each pair of places still meets once.
    """
    a = indexed.select(F.col("seq_id").alias("seq_a"), "centre", "kmer")
    b = indexed.select(F.col("seq_id").alias("seq_b"), F.col("centre").alias("other"), "kmer")
    turned = b.withColumn("kmer", reverse_complement("kmer"))
    frequent = indexed.groupBy("kmer").agg(F.ceil(F.count("*") / block).cast("int").alias("m")).where("m > 1")
    split = not frequent.isEmpty()
    here = F.col("shift").between(*shifts) if shifts else F.lit(True)
    near = F.abs(F.col("other") - F.col("centre") * band[0] - band[1]) <= band[2] if band else F.lit(True)
    out = []
    for way, other, shift in ((1, b, F.col("centre") - F.col("other")), (-1, turned, F.col("centre") + F.col("other"))):
        if band and (band[0] > 0) != (way > 0):
            continue
        if split:
            theirs = frequent.select(F.col("kmer") if way == 1 else reverse_complement("kmer").alias("kmer"), F.col("m").alias("n"))
            blocks = frequent.join(theirs, "kmer", "full")
            met = dealt(a, blocks, "seq_a", "centre", "m", "n", ("i", "j")).join(dealt(other, blocks, "seq_b", "other", "n", "m", ("j", "i")), ["kmer", "i", "j"])
        else:
            met = a.join(other, "kmer")
        met = met.where("seq_a < seq_b").where(near).select("seq_a", "seq_b", F.lit(way).alias("dir"), shift.alias("shift"), "centre")
        out.append(met.where(here))
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def dealt(side: DataFrame, blocks: DataFrame, name: str, place: str, own: str, other: str, to: tuple[str, str]) -> DataFrame:
    """Rows of ``side`` in their own block, once for every block of the other side, for k-mers of several blocks; in block 0 for the others."""
    rows = side.join(blocks, "kmer", "left").withColumns({c: F.coalesce(c, F.lit(1)) for c in (own, other)})
    rows = rows.withColumn(to[0], F.pmod(F.xxhash64(name, place), F.col(own)).cast("int"))
    return rows.select(name, place, "kmer", to[0], F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(to[1]))


def best_offsets(counted: DataFrame, least: int = 10) -> DataFrame:
    """seq_a, seq_b, dir, shift, n: each pair of enough common k-mers at its best offset (the lowest if tied, then the forward one)."""
    best = counted.groupBy("seq_a", "seq_b").agg(F.max(F.struct("n", (-F.col("shift")).alias("s"), "dir")).alias("p")).where(F.col("p.n") >= least)
    return best.select("seq_a", "seq_b", F.col("p.dir").alias("dir"), (-F.col("p.s")).alias("shift"), F.col("p.n").alias("n"))


def alignment_segments(indexed: DataFrame, k: int, sequences: DataFrame, drift: int = 5, share: int = 20, least: int | None = None) -> DataFrame:
    """seq_a, seq_b, dir, shift, first_base, last_base (in a): the stretches in which a pair agrees, near its peak.

    The peak is the offset of the most k-mers (lowest offset if tied).  Offsets within ``drift`` of it and of at least one
    ``share``-th of its count are kept; their runs of consecutive places, extended by half a k-mer, are segments if at least ``least`` long,
    by default the logarithm of the product of both sequences' numbers of k-mers.  With ``copies`` a pair comes in both orders where one may be asked for.  Segments inside others go, overlaps are shared out, segments of discordant offsets
    go, and segments that only unread letters part become one.
    """
    whole, line = W.partitionBy(*PAIR, "shift"), W.partitionBy(*PAIR, "shift").orderBy("centre", "last")
    size = F.when(F.col("last"), F.col("centre") + 1).otherwise(-F.col("centre"))
    ends = ends_of(indexed)
    if "copies" in ends.columns:
        ends = both_orders(ends)
    runs = ends.repartition(*PAIR).select(*PAIR, "shift", "centre", "last", F.lead("centre").over(line).alias("end"), F.sum(size).over(whole).alias("n")).where("not last")
    runs = runs.withColumn("p", F.max(F.struct("n", (-F.col("shift")).alias("s"))).over(W.partitionBy(*PAIR)))
    near = runs.where((F.abs(F.col("shift") + F.col("p.s")) <= drift) & (F.col("n") * share >= F.col("p.n")))
    at = near.select(*PAIR, "shift", (F.col("centre") - k // 2).alias("first_base"), (F.col("end") + k // 2).alias("last_base"))
    if least is None:
        sizes = indexed.groupBy("seq_id").agg(F.count("*").cast("double").alias("m"))
        at = at.join(sizes.select(F.col("seq_id").alias("seq_a"), F.col("m").alias("ma")), "seq_a").join(sizes.select(F.col("seq_id").alias("seq_b"), F.col("m").alias("mb")), "seq_b")
        at = at.where(F.col("last_base") - F.col("first_base") + 1 >= F.floor(F.log(F.col("ma") * F.col("mb")))).drop("ma", "mb")
    else:
        at = at.where(F.col("last_base") - F.col("first_base") + 1 >= least)
    return joined(settled(concordant(parted(outermost(at)))), sequences)


def both_orders(ends: DataFrame) -> DataFrame:
    """``breaks`` with those of a pair once more with its sequences in the other order, if the first has ``copies``, as these may come after the second."""
    forward = F.col("dir") == 1
    turns = F.when(F.col("copies") & (F.col("seq_a") != F.col("seq_b")), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    each = ends.withColumn("turn", F.explode(turns))
    swap = lambda plain, other: F.when(F.col("turn"), other).otherwise(plain)
    shift, last = F.when(forward, -F.col("shift")).otherwise(F.col("shift")), F.when(forward, F.col("last")).otherwise(~F.col("last"))
    return each.select(swap(F.col("seq_a"), F.col("seq_b")).alias("seq_a"), swap(F.col("seq_b"), F.col("seq_a")).alias("seq_b"), "dir", swap(F.col("shift"), shift).alias("shift"),
                       swap(F.col("centre"), in_b("centre")).alias("centre"), swap(F.col("last"), last).alias("last"))


def in_b(place: str) -> Column:
    """The place in b that belongs to one in a."""
    return F.when(F.col("dir") == 1, F.col(place) - F.col("shift")).otherwise(F.col("shift") - F.col(place))


def outermost(segments: DataFrame) -> DataFrame:
    """Segments that lie inside no other of their pair, in a or in b.  Of two with the same place in either, neither stays."""
    low, high = (F.least(in_b("first_base"), in_b("last_base")), F.greatest(in_b("first_base"), in_b("last_base")))
    out = segments.withColumn("low", low).withColumn("high", high)
    for first, last in (("first_base", "last_base"), ("low", "high")):
        before = W.partitionBy(*PAIR).orderBy(first, F.col(last).desc(), "shift").rowsBetween(W.unboundedPreceding, -1)
        alone = F.count("*").over(W.partitionBy(*PAIR, first, last)) == 1
        out = out.withColumn(f"{first}_out", alone & (F.coalesce(F.max(last).over(before), F.col(last) - 1) < F.col(last)))
    return out.where("first_base_out and low_out").select(segments.columns)


def parted(segments: DataFrame) -> DataFrame:
    """Segments cut back where neighbours (by place in a) overlap in a or in b: each gives half of the larger overlap, rounded up."""
    line = W.partitionBy(*PAIR).orderBy("first_base", "last_base", "shift")
    start, end, way = in_b("first_base"), in_b("last_base"), F.col("dir")
    out = segments.withColumn("start", start * way).withColumn("end", end * way)
    overlap = F.greatest(F.col("last_base") - F.lead("first_base").over(line), F.col("end") - F.lead("start").over(line)) + 1
    out = out.withColumn("give", F.floor((F.greatest(F.coalesce(overlap, F.lit(0)), F.lit(0)) + 1) / 2))
    took = F.coalesce(F.lag("give").over(line), F.lit(0))
    cut = out.withColumns({"first_base": F.col("first_base") + took, "last_base": F.col("last_base") - F.col("give")})
    return cut.where("first_base <= last_base").select(segments.columns)


def concordant(segments: DataFrame, window: int = 5, threshold: int = 10) -> DataFrame:
    """Segments whose offset is within ``threshold`` of the median of those of up to ``window`` neighbours on each side."""
    line = W.partitionBy(*PAIR).orderBy("first_base", "last_base", "shift").rowsBetween(-window, window)
    near = F.sort_array(F.collect_list("shift").over(line))
    median = F.get(near, F.floor(F.size(near) / 2).cast("int"))
    return segments.withColumn("off", F.abs(median - F.col("shift"))).where(F.col("off") <= threshold).drop("off")


def joined(segments: DataFrame, sequences: DataFrame, unread: str = "NX*-") -> DataFrame:
    """Neighbours of one offset with a gap between them become one segment if every letter of b in the gap is that of a, or one of ``unread``."""
    line = W.partitionBy(*PAIR).orderBy("first_base", "last_base", "shift")
    at = segments.withColumn("from", F.when(F.lag("shift").over(line) == F.col("shift"), F.lag("last_base").over(line) + 1))
    gaps = at.where("from < first_base").withColumn("to", F.col("first_base") - 1)
    text = lambda name, to: sequences.select(F.col("seq_id").alias(name), F.upper("dna").alias(to))
    gaps = gaps.join(text("seq_a", "a"), "seq_a").join(text("seq_b", "b"), "seq_b")
    low, size = F.least(in_b("from"), in_b("to")), F.col("to") - F.col("from") + 1
    cut = F.substring("b", low.cast("int"), size.cast("int"))
    mine, theirs = F.split(F.substring("a", F.col("from").cast("int"), size.cast("int")), ""), F.split(F.when(F.col("dir") == 1, cut).otherwise(reverse_complement(cut)), "")
    fits = F.forall(F.zip_with(mine, theirs, lambda x, y: (x == y) | F.lit(unread).contains(y)), lambda x: x)
    fits = gaps.where(fits).select(*PAIR, "shift", "first_base", F.lit(0).alias("new"))
    marked = segments.join(fits, [*PAIR, "shift", "first_base"], "left").withColumn("island", F.sum(F.coalesce("new", F.lit(1))).over(line))
    return marked.groupBy(*PAIR, "shift", "island").agg(F.min("first_base").alias("first_base"), F.max("last_base").alias("last_base")).drop("island")


def oligo_hits(sequences: DataFrame, oligos: dict[str, str]) -> DataFrame:
    """oligo, strand, seq_id, offset (from 0): non-overlapping places of each oligo, with pads inside allowed.

    Both strands are searched, but a palindrome once.  The oligo is upper-cased; sequences match as upper case too.  A sequence is read once, where it lies.
    """
    turn, patterns = str.maketrans("ACGT", "TGCA"), []
    for name, oligo in oligos.items():
        forward = oligo.upper()
        reverse = "".join(c if c in "ACGT" else "N" for c in forward)[::-1].translate(turn)
        for strand, pattern in (("F", forward), ("R", reverse)) if reverse != forward else (("F", forward),):
            patterns.append((name, strand, pattern, re.compile(oligo_pattern(pattern))))

    def work(ids: list, texts: list[str]) -> dict[str, pa.Array]:
        out = []
        for i, t in zip(ids, texts):
            padded = "-" in t
            for name, strand, plain, regex in patterns:
                if padded or plain in t:
                    out += [(name, strand, i, m.start()) for m in regex.finditer(t)]
        columns = list(zip(*out)) or [()] * 4
        return {n: pa.array(columns[k], t) for k, (n, t) in enumerate((("oligo", pa.string()), ("strand", pa.string()), ("seq_id", pa.int64()), ("offset", pa.int64())))}

    return scanned(sequences.select("seq_id", F.upper("dna").alias("dna")), work, "oligo string, strand string, seq_id long, offset long")


def oligo_tags(sequences: DataFrame, oligos: dict[str, str]) -> DataFrame:
    """oligo, strand, seq_id, first_base, last_base: the first place of each oligo in each read, on either strand."""
    first = oligo_hits(sequences, oligos).groupBy("oligo", "strand", "seq_id").agg(F.min("offset").alias("offset"))
    size = F.create_map(*(F.lit(v) for name, o in oligos.items() for v in (name, len(o))))
    return first.select("oligo", "strand", "seq_id", (F.col("offset") + 1).alias("first_base"), (F.col("offset") + F.element_at(size, F.col("oligo"))).alias("last_base"))
