r"""Quality rules: log-likelihood ratio of hashed n-grams between trusted texts and the raw corpus.

Words ``[^\x20\x09-\x0D]+`` and pairs of neighbouring words are hashed into ``buckets``.  Two multinomials over the
buckets are counted: one of the trusted texts (all documents labelled of good quality), one of all documents.  ``smoothing`` is added to the trusted count and, scaled to the
size of the corpus, to the raw count, so that words of one text only do not tell trusted texts from others.  A document's ``score`` is the sum of ``ln(target / raw)`` over its
n-grams, divided by their number; it is kept when it passes the base rules and its score reaches ``threshold``.

Everything is DataFrame functions: word hashes, pair hashes (by zipping an array with itself shifted) and window
hashes live in arrays of the row.  Texts with an id are shuffled once, to meet the ids of trusted ones, as these ids grow with
the corpus; then only bucket counts are.  The two weight
tables come to the driver (``buckets`` numbers, a parameter) and go back as one literal array.

Edge cases: a null text has no words and fails the base rules; a text without words has a null score.  Without
trusted texts all weights are 0 and the base rules alone decide.  Documents with several labels count as trusted
if any label is 1; rows with a null id never do.  Repeated rows are each counted and judged.  A text of any length is judged whole, in
arrays of its row.  Scores equal to the threshold pass.  Columns of ``docs`` may have the names of the new ones.  Empty tables give no
rows.  Bucket counts are integers, so results do not depend on the order of rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm.batches import BLANKS, table


def hashed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__words`` and their hashes ``__h``, and hashes of neighbouring pairs ``__p``."""
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), BLANKS), "")
    out = docs.withColumn("__words", words).withColumn("__h", F.transform("__words", lambda w: F.xxhash64(w)))
    return out.withColumn("__n", F.size("__h")).withColumn("__p", paired("__h", F.col("__n"), 1))


def paired(name: str, n: Column, gap: int) -> Column:
    """Hashes of (element i, element i + gap) of an array of n longs; empty if n <= gap."""
    rest = F.greatest(n - gap, F.lit(0))
    return F.zip_with(F.slice(name, F.lit(1), rest), F.slice(name, F.lit(gap + 1), rest), lambda a, b: F.xxhash64(a, b))


def bucket(h: Column, buckets: int) -> Column:
    return h.bitwiseAND(F.lit(buckets - 1))


#: Keys that a repeated id's rows are dealt to when they meet the trusted ids.
SALTS = 16


def bucket_counts(docs: DataFrame, labels: DataFrame, buckets: int) -> list[tuple[int, int, int]]:
    """bucket, count over all documents, count over the trusted ones.

    Texts without an id are counted where they are read; the others move to meet the trusted ids, those of one id dealt by text.
    """
    good = labels.where("quality = 1").select("doc_id").na.drop().distinct().withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    good = good.withColumn("__good", F.lit(1)).hint("shuffle_hash")
    texts = docs.select("doc_id", "text")
    salted = texts.where("doc_id is not null").withColumn("__salt", F.pmod(F.xxhash64("text"), F.lit(SALTS)).cast("int"))
    marked = salted.join(good, ["doc_id", "__salt"], "left").select("text", "__good")
    marked = marked.unionByName(texts.where("doc_id is null").select("text", F.lit(None).cast("int").alias("__good")))
    each = hashed(marked).select("__good", F.explode(F.concat("__h", "__p")).alias("h"))
    counted = each.groupBy(bucket(F.col("h"), buckets).alias("b")).agg(F.count("*").alias("raw"), F.count("__good").alias("target"))
    return [tuple(r) for r in counted.collect()]


def weights(counts: list[tuple[int, int, int]], buckets: int, smoothing: float) -> list[float]:
    r_all, t_all = sum(r for _, r, _ in counts), sum(t for _, _, t in counts)
    out = [0.0] * buckets
    for b, r, t in counts if t_all else ():
        out[b] = math.log(t + smoothing) - math.log(r * t_all / r_all + smoothing)
    return out


def judge(docs: DataFrame, labels: DataFrame, buckets: int = 1 << 16, smoothing: float = 10.0, threshold: float = -0.085) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score and kept.

    Input columns stay under their names in a struct ``doc``, so that none clashes with the new ones.
    """
    w = weights(bucket_counts(docs, labels, buckets), buckets, smoothing)
    table_of = F.split(F.lit(",".join(map(repr, w))), ",").cast("array<double>")
    looked = lambda name: F.aggregate(
        name, F.lit(0.0), lambda acc, h: acc + F.get(table_of, bucket(h, buckets).cast("int"))
    )
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike("[^ \t-\r]"))
    one = docs.select(F.struct(*docs.columns).alias("doc"), F.col("text"))
    at = hashed(one).withColumn("__lines", lines).withColumn("__q", paired("__p", F.col("__n") - 1, 2))
    rest = F.greatest(F.col("__n") - 4, F.lit(0))
    five = F.zip_with(F.slice("__q", F.lit(1), rest), F.slice("__h", F.lit(5), rest), lambda a, b: F.xxhash64(a, b))
    at = at.withColumn("__f", five)
    sorted_f = F.sort_array(F.transform("__f", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    covered = F.transform(F.array(sorted_f), lambda s: words_covered(s)).getItem(0)
    repeated = F.when(F.size(F.array_distinct("__f")) < F.size("__f"), covered).otherwise(F.lit(0))
    out = at.select(
        "doc",
        F.col("__n").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        repeated.cast("long").alias("n_repeat_words"),
        F.when(F.col("__n") > 0, (looked("__h") + looked("__p")) / (F.col("__n") * 2 - 1)).alias("score"),
    )
    failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & F.coalesce(F.col("score") >= threshold, F.lit(False)))


def words_covered(s: Column) -> Column:
    """Words inside five-word windows whose hash stands twice or more in ``s``, the windows sorted by (hash, place)."""
    near = lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))
    places = F.sort_array(F.transform(F.filter(s, lambda x, i: near(x, i)), lambda x: x["i"]))
    start = F.struct(F.lit(0).alias("n"), F.lit(-5).alias("last"))
    step = lambda acc, i: F.struct((acc["n"] + F.least(F.lit(5), i - acc["last"])).alias("n"), i.alias("last"))
    return F.aggregate(places, start, step, lambda acc: acc["n"])


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = judge(docs, table(spark, sf_dir, "labels"))
    return judged.select("doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns.

    The verdict passes through a generator of one row, as Catalyst pushes a filter through projections and would then
    evaluate the hashes once more for each of its terms.
    """
    judged = judge(docs, labels, **options).select("doc", F.explode(F.array("kept")).alias("kept"))
    return judged.where("kept").select("doc.*")
