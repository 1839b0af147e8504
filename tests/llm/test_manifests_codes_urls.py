"""Merkle manifests, vector codes and URL filters against plain versions on small fixtures with nulls, ties and repeated rows."""

import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from strandlake.llm import merkle, url_filter, vector_codes
from strandlake.llm.catalog import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long, leaf string, tree string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    doc_id, _, lang, source, n_chars = row[:5]
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return sha(*map(field, (doc_id, source, lang, n_chars, text)))


def climbed(nodes):
    """The top over ``nodes`` and the siblings (left, right) of each, from the lowest level up."""
    paths, groups = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        above, merged = [], []
        for at in range(0, len(nodes), 16):
            run = nodes[at : at + 16]
            for k in range(len(run)):
                for i in groups[at + k]:
                    paths[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
            above.append(sha(*run))
            merged.append([i for g in groups[at : at + 16] for i in g])
        nodes, groups = above, merged
    return nodes[0], paths


def plain_manifest(rows):
    order = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    own = {s: sorted((r for r in rows if r[3] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1]))) for s in order}
    trees = [climbed([leaf(r, r[1]) for r in own[s]]) for s in order]
    root, over = climbed([t for t, _ in trees])
    out = []
    for s, (subroot, paths), upper in zip(order, trees, over):
        for r, path in zip(own[s], paths):
            text = r[1]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            up = leaf(r, text)
            for left, right in path + upper:
                up = sha(left, up, right)
            out.append((r[0], leaf(r, r[1]), subroot, root, sha(*(a + b for a, b in path + upper)), up, up == root))
    return out


@pytest.mark.parametrize("case", ["many", "one", "equal", "no ids"])
def test_manifest_is_the_plain_one(spark, tmp_path, case):
    rng = random.Random(case)
    if case == "many":
        rows = [(i, rng.choice(["Große Straße", "plain", "", None, "A" * 5000]), "en", rng.choice(["a", "a", "a", "é", None, "z", "B", ""]), i % 7 or None, "x", None) for i in range(700)]
        rows += [(10_000 + i, "Text", None, f"s{i}", 4, "x", "y") for i in range(40)] + rows[:30] + [(None, f"T{i % 3}", None, "a", None, None, None) for i in range(50)]
    elif case == "one":
        rows = [(5, "Only", "en", None, 4, "x", "y")]
    elif case == "equal":
        rows = [(5, "Same", "en", "a", 4, "x", "y")] * 300
    else:
        rows = [(None, f"T{i}", "en", "a", 4, "x", "y") for i in range(257)]
    rng.shuffle(rows)
    spark.createDataFrame(rows, DOCS).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["op11_merkle"](spark, str(tmp_path))
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    found = [tuple(r) for r in found.collect()]
    assert sorted(found, key=str) == sorted(plain_manifest(rows), key=str)
    assert case != "many" or {r[-1] for r in found} == {True, False}


def test_manifest_gives_paths_of_any_rows(spark):
    rows = spark.range(100).select(F.lit("one").alias("source"), F.col("id").alias("doc_id"), F.unhex(F.sha2(F.col("id").cast("string").cast("binary"), 256)).alias("leaf"), F.lit(1).alias("more"))
    found = merkle.proofs(rows).collect()
    assert len(found) == 100 and len({r["root"] for r in found}) == 1 and {r["more"] for r in found} == {1}
    for r in found:
        up = hashlib.sha256(str(r["doc_id"]).encode()).hexdigest()
        assert r["leaf"] == up
        for p in r["path"]:
            up = sha(p["left"], up, p["right"])
        assert up == r["root"] == r["subroot"]


def test_hilbert_curve_visits_neighbours():
    points = np.array(list(itertools.product(range(8), repeat=3)))
    at = vector_codes.hilbert(points, 3)
    assert sorted(at) == list(range(512))
    assert set(np.abs(np.diff(points[np.argsort(at)], axis=0)).sum(1)) == {1}


def plain_codes(rows):
    usable = [(i, v, y) for i, v, y in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    usable.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    cut = [[[max(-(1 << 24), min(1 << 24, math.floor(256 * x))) for x in v[p * len(v) // 16 : (p + 1) * len(v) // 16]] for p in range(16)] for _, v, _ in usable]
    books = [[list(c[p]) for c in cut[:64]] for p in range(16)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda x, book: min((far(x, e), k) for k, e in enumerate(book))
    for _ in range(2):
        for p, book in enumerate(books):
            members = {}
            for c in cut:
                members.setdefault(nearest(c[p], book)[1], []).append(c[p])
            for k, own in members.items():
                book[k] = [sum(x) // len(own) for x in zip(*own)]
    best = [[nearest(c[p], books[p]) for p in range(16)] for c in cut]
    errors = [sum(d for d, _ in b) for b in best]
    labels = {}
    for (_, _, y), e in zip(usable, errors):
        labels[y] = labels.get(y, 0) + e
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return [(i, "".join(f"{k:02x}" for _, k in b), e, labels[y], digest) for (i, _, y), b, e in zip(usable, best, errors)]


@pytest.mark.parametrize("n, dims", [(700, 48), (40, 16), (300, 32)])
def test_codes_are_the_plain_ones(spark, tmp_path, n, dims):
    rng = np.random.RandomState(n)
    vectors = np.float32(rng.randn(n, dims) * rng.choice([0.01, 1, 300], (n, 1))) if n != 300 else np.float32(rng.randint(-3, 3, (n, dims)) / 256)
    rows = [(int(i), [float(x) for x in v], None if i % 3 == 0 else int(i % 3)) for i, v in enumerate(vectors)]
    rows += [(None, rows[3][1], 7), (rows[5][0], rows[6][1], 7), rows[8], (901, None, 1), (902, [None] + [1.0] * (dims - 1), 1), (903, [math.nan] * dims, 1), (904, [-math.inf] * dims, 2)]
    rows += [(905 + i, [70_000.0 + i] * dims, 9) for i in range(3)] if n == 700 else []
    made = [(i, v, y, "x", "y") for i, v, y in rows]
    spark.createDataFrame(made, "vec_id long, embedding array<float>, label int, code string, error string").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    found = QUERIES["op13_vector_codes"](spark, str(tmp_path))
    assert found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    want = sorted(map(str, plain_codes(rows)))
    assert sorted(str(tuple(r)) for r in found.collect()) == want
    small, books = vector_codes.compress(spark.createDataFrame(made, found.sparkSession.read.parquet(f"{tmp_path}/embeddings.parquet").schema), rows=37)
    assert hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest() in want[0]
    assert small.count() == len(want)


def test_codes_leave_other_lengths_out(spark):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    found, books = vector_codes.compress(frame([(1, [0.5] * 16, 1), (2, [0.5] * 32, 1), (3, [], 1)]))
    assert [r["vec_id"] for r in found.collect()] == [1] and books.shape == (16, 1, 1)
    assert vector_codes.compress(frame([(1, [], 1), (2, [0.5] * 16, 1)]))[0].count() == 0
    assert vector_codes.compress(frame([(1, [0.5] * 20, 1)]))[0].count() == 0


def test_labels_of_any_weight_meet_their_sum(spark):
    rows = spark.range(4000).selectExpr("id as vec_id", "cast(if(id % 3 = 0, null, if(id % 3 = 1, 1, id)) as int) as label", "id as error")
    sums = {}
    for i in range(4000):
        y = (None, 1, i)[i % 3]
        sums[y] = sums.get(y, 0) + i
    found = vector_codes.with_label_error(rows).collect()
    assert len(found) == 4000 and all(r["label_error"] == sums[r["label"]] for r in found)


def test_shortlists_leave_every_nearest_entry():
    rng = np.random.RandomState(4)
    points = np.sort(rng.randint(-300, 300, (1000, 3)), axis=0).astype(np.int32)
    entries = rng.randint(-300, 300, (64, 3)).astype(np.int64)
    starts = np.arange(0, 1000, vector_codes.BLOCK)
    blocks = vector_codes.Blocks(points, np.minimum.reduceat(points, starts), np.maximum.reduceat(points, starts), np.add.reduceat(points, starts, dtype=np.int64))
    gap = ((points[:, None].astype(np.int64) - entries[None]) ** 2).sum(2)
    for errors in (True, False):
        index, far, sums, counts = blocks.assigned(entries, errors)
        assert list(index) == list(gap.argmin(1))
        if errors:
            assert list(far) == list(gap.min(1))
        else:
            assert all((sums[k] == points[index == k].sum(0)).all() and counts[k] == (index == k).sum() for k in range(64))


URLS = [
    None, "", "no scheme", "://", "http://", "HTTP://Sub.Example.ORG/es/x?y#z", "http://example.org/es", "http://example.org/en/12#a", "http://notexample.org/es/1", "http://a.b.c.com/fr/", "https://com/de/?q=://x",
    "http://x.com/de/1?a", "http://x.com?/de/", "http://x.com#/de/", "ftp://x.org", "http://x.org:80/", "http://ÄB.org/x", "a://b://c.org/d", "http://" + "a." * 5000 + "com/fr/" + "x" * 100_000, "http://x.net/deep/er/and/deeper",
    "http://net/deep/", "http://y.x.net/deep/e", "http://..org/", "http://x.com/FR/", "http://k.io/aé/b", "http://k.io/aé",
]
MORE = [("net", "/deep/", "allow"), ("x.net", "/deep/er", "block"), ("X.NET", "/deep/er", "allow"), ("k.io", "/aé/", "block"), ("k.io", None, "allow"), (None, "/", "block"), ("", "", "block"), ("io", "/aé/b", "allow"), ("q.io", "/", None)]


def plain_verdict(url, rules):
    host, path = "", ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        end = min((i for i, c in enumerate(rest) if c in "/?#"), default=len(rest))
        host, rest = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), rest[end:]
        path = rest[: min((i for i, c in enumerate(rest) if c in "?#"), default=len(rest))]
    fits = []
    for h, p, action in rules:
        h, p = (h or "").lower(), p or ""
        if h and action and (host == h or host.endswith("." + h)) and path.startswith(p):
            fits.append((len(h) + len(p), len(h), action, h + p))
    if fits:
        _, _, action, rule = max(fits)
        return host, path, rule, action
    return host, path, None, "allow" if host else "block"


def test_urls_are_judged_as_plainly(spark):
    rng = random.Random(2)
    urls = URLS + ["".join(rng.choice(["://", "/", "?", "#", ".", "org", "example", "com", "es", "fr", "A", "de", "en/1"]) for _ in range(rng.randint(1, 14))) for _ in range(500)] + [URLS[5]] * 20
    pages = spark.createDataFrame([(i, u, "clash", 1) for i, u in enumerate(urls)], "page_id long, url string, rule string, host int")
    for rules in (url_filter.RULES, url_filter.RULES + MORE, []):
        found = url_filter.filtered(pages.repartition(3), url_filter.rules_of(spark, rules), rows=50).collect()
        assert len(found) == len(urls)
        for r in found:
            assert (r["host"], r["path"], r["rule"], r["verdict"]) == plain_verdict(urls[r["page_id"]], rules), urls[r["page_id"]][:80]


def test_many_rules_are_found(spark):
    rules = spark.range(20_000).selectExpr("concat('h', id % 5000, '.net') as host", "concat('/p', id) as path", "'block' as action")
    pages = spark.range(0, 20_000, 7).selectExpr("id as page_id", "concat('http://www.h', id % 5000, '.net/p', id, if(id % 2 = 0, '/x', '')) as url")
    found = url_filter.filtered(pages, rules).collect()
    for r in found:
        want = max((f"/p{i}" for i in range(r["page_id"] % 5000, 20_000, 5000) if r["path"].startswith(f"/p{i}")), key=len)
        assert (r["rule"], r["verdict"]) == (r["host"][4:] + want, "block")


def test_equal_digests_are_told_apart(tmp_path, monkeypatch):
    array = url_filter.DigestArray.__new__(url_filter.DigestArray)
    texts = [b"rone", b"rtwo", b"rthree"]
    array.keys = np.array([7, 7, 7], np.int64)
    array.ends = np.cumsum([len(x) for t in texts for x in (t, b"v" + t)])
    array.data = np.frombuffer(b"".join(t + b"v" + t for t in texts), np.uint8)
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda text, seed: 7)
    assert array.values([b"rthree", b"rfour", b"rone"]) == [b"vrthree", None, b"vrone"]


def test_digests_are_those_of_spark(spark):
    for text in ("", "rexample.org/é"):
        mine = spark.sql("select xxhash64(:t)", args={"t": text}).first()[0]
        assert mine % (1 << 64) == xxhash.xxh64_intdigest(text.encode(), url_filter.SEED)


def test_rules_are_laid_out_by_any_worker(tmp_path, monkeypatch):
    def refused(*_):
        raise OSError

    texts = [b"hcom", b"rcom/fr/"]
    keys = [xxhash.xxh64_intdigest(t, url_filter.SEED) for t in texts]
    rows = sorted(zip(np.array(keys, np.uint64).view(np.int64).tolist(), (t.decode() for t in texts), ("4", "allow")))
    pq.write_table(pa.table({"key": pa.array([r[0] for r in rows], pa.int64()), "text": [r[1] for r in rows], "value": [r[2] for r in rows]}), tmp_path / "part-0")
    monkeypatch.setattr(url_filter.SparkFiles, "getRootDirectory", classmethod(lambda cls: str(tmp_path)))
    monkeypatch.setattr(url_filter.SparkFiles, "get", classmethod(lambda cls, name: str(tmp_path / name)))
    monkeypatch.setattr(url_filter.os, "rename", refused)
    first = url_filter.DigestArray(["part-0"])
    url_filter.DigestArray.lay_out(["part-0"], str(tmp_path / "part-0"))  # a second worker, at the same time
    for array in (first, url_filter.DigestArray(["part-0"])):
        assert array.values([*texts, b"hde"]) == [b"4", b"allow", None]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["part-0", "part-0.data", "part-0.ends", "part-0.keys"]
