"""The whole pipeline and the quality rules against plain Python; empty tables through every operator."""

import hashlib
import math
import random
import re
import struct
from collections import Counter
from fractions import Fraction

import pytest
import xxhash

import corpus_pipeline
from strandlake.llm import catalog, mixing, quality_rules, sharding, subword

SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long, kept string",
    "labels": "doc_id long, quality int, toxic int", "benchmark": "item_id long, text string", "pages": "page_id long, url string, html string",
    "embeddings": "vec_id long, embedding array<float>, label int",
}


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def folded(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def hashed(*values):
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(v if isinstance(v, bytes) else struct.pack("<q", v), h)
    return h - (1 << 64 if h >> 63 else 0)


def judged(rows, good, threshold=-0.085, smoothing=10.0, buckets=1 << 16):
    """(score, base_failed, n_repeat_words, n_symbols) of every text."""
    grams = []
    for _, text, *_ in rows:
        h = [hashed(w.encode()) for w in words_of(text)]
        grams.append([x % buckets for x in h + [hashed(a, b) for a, b in zip(h, h[1:])]])
    raw, target = Counter(b for g in grams for b in g), Counter(b for r, g in zip(rows, grams) if r[0] in good for b in g)
    r_all, t_all = sum(raw.values()), sum(target.values())
    weight = {b: math.log(target[b] + smoothing) - math.log(n * t_all / r_all + smoothing) for b, n in raw.items()}
    out = []
    for (_, text, *_), g in zip(rows, grams):
        w = words_of(text)
        five = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        times = Counter(five)
        repeated = len({k for i, x in enumerate(five) if times[x] > 1 for k in range(i, i + 5)})
        failed = len(w) < 10 or 100 * repeated > 20 * len(w)
        out.append((sum(weight[b] for b in g) / len(g) if g else None, failed, repeated, sum(c in "#*$%&|<>" for c in text or "")))
    return out


def near_copies(rows):
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := folded(r[1])) else None for r in rows]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and Fraction(len(sets[a] & sets[b]), len(sets[a] | sets[b])) >= Fraction(4, 5):
                root = [root[b] if r == root[a] else r for r in root]
    key = lambda r: (r[0] is None, r[0] or 0, hashlib.md5(r[1].encode()).digest())
    groups: dict[int, list] = {}
    for r, g in zip(rows, root):
        groups.setdefault(g, []).append(r)
    return [min(g, key=key) for g in groups.values()]


def decontaminated(rows, items):
    windows = {tuple(w[i : i + 10]) for t in items if (w := folded(t)) for i in range(max(1, len(w) - 9))}
    out = []
    for doc_id, text, lang, source, n_chars, other in rows:
        places = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
        w, hit = folded(text), set()
        assert len(w) == len(places)
        for x in windows:
            for i in range(len(w) - len(x) + 1):
                if tuple(w[i : i + len(x)]) == x:
                    hit |= set(range(i, i + len(x)))
        gone = set()
        for k in hit:
            gone |= set(range(places[k][0], places[k + 1][0] if k + 1 in hit else places[k][1]))
        text = "".join(c for i, c in enumerate(text) if i not in gone)
        out.append((doc_id, text, lang, source, len(text) if hit else n_chars, other))
    return out


def mixed(rows):
    size = {id(r): len(words_of(r[1])) for r in rows}
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    own = {s: sum(size[id(r)] for r in rows if r[3] == s) for s in sources}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    target, free, left = {}, set(sources), float(sum(own.values()))
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        full = {s for s in free if share[s] > 3 * own[s]}
        if not full:
            target |= share
            break
        target |= {s: 3.0 * own[s] for s in full}
        left -= sum(3 * own[s] for s in full)
        free -= full
    out = []
    for s in sources:
        md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
        band = lambda n: len(f"{n:b}") * 16 + ((n * 16) >> len(f"{n:b}"))
        tie = lambda r: md5(r[1]) if r[0] is None else ""
        order = lambda r: (band(size[id(r)]), int(md5(tie(r) or str(r[0]))[8:12], 16) % mixing.HASHES, size[id(r)], r[0] is not None, r[0] or 0, tie(r))
        rate = target[s] / own[s] if own[s] else 0.0
        u = int(md5(f"offset:{int(s is None)}:{s or ''}")[:8], 16) / 2**32
        for k, r in enumerate(sorted((r for r in rows if r[3] == s), key=order), 1):
            out += [r] * (math.floor(k * rate + u) - math.floor((k - 1) * rate + u))
    return out


def prose(rng, n, words):
    return " ".join(rng.choice(words) + rng.choice(["", "", ",", "."]) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    good, bad = [f"good{i}" for i in range(60)], [f"$bad{i}|" for i in range(60)]
    passage = "Zero one two three four five six seven eight nine ten eleven"
    texts = [prose(rng, rng.randint(12, 90), good if i % 3 else bad) for i in range(70)]
    texts += [texts[1] + " added", texts[1], texts[4] + f" {passage}! " + texts[5], None, "", "short", "same words here " * 20]
    rows = [(i, t, "en", [None, "a", "b", "b", "c"][i % 5], None if t is None else len(t), "clash") for i, t in enumerate(texts)]
    rows += [(None, texts[7] + " x y", "en", "a", 1, "clash"), rows[8], rows[8], (None, texts[10][::-1], "fr", "b", 1, None)]
    tables = {
        "documents": rows, "labels": [(i, int(i % 3 > 0), 0) for i in range(0, 60)] + [(1, 0, 0), (None, 1, 0)],
        "benchmark": [(1, passage), (2, None), (3, "")], "pages": [], "embeddings": [],
    }
    at = tmp_path_factory.mktemp("tables")
    for name, schema in SCHEMAS.items():
        spark.createDataFrame(tables[name], schema).write.parquet(str(at / f"{name}.parquet"))
    return str(at), tables


def test_quality_rules_are_the_plain_ones(spark, folder):
    at, tables = folder
    rows = tables["documents"]
    want = judged(rows, {i for i, q, _ in tables["labels"] if q and i is not None})
    by_text = {r[1]: w for r, w in zip(rows, want)}
    docs, labels = (spark.read.parquet(f"{at}/{n}.parquet") for n in ("documents", "labels"))
    found = quality_rules.judge(docs, labels).select("doc.text", "*").collect()
    assert len(found) == len(rows) and {r["kept"] for r in found} == {True, False}
    for r in found:
        score, failed, repeated, symbols = by_text[r["text"]]
        assert r["score"] == (None if score is None else pytest.approx(score, abs=1e-9))
        assert (r["base_failed"], r["n_repeat_words"], r["n_symbols"]) == (failed, repeated, symbols)
        assert r["kept"] == (not failed and score >= -0.085)


def test_pipeline_is_the_plain_one(spark, folder):
    at, tables = folder
    rows = tables["documents"]
    verdict = judged(rows, {i for i, q, _ in tables["labels"] if q and i is not None})
    kept = [r for r, (score, failed, *_) in zip(rows, verdict) if not failed and score >= -0.085]
    unique = near_copies(kept)
    clean = decontaminated(unique, [t for _, t in tables["benchmark"]])
    want = mixed(clean)
    assert len(rows) > len(kept) > len(unique) > 20 and any(a[1] != b[1] for a, b in zip(unique, clean)) and sorted(map(str, want)) != sorted(map(str, clean))
    owner = sharding.fill(sharding.SHARDS, sharding.SLOTS)
    slot = lambda r: int(hashlib.md5((f"text:{r[1]}" if r[0] is None else str(r[0])).encode()).hexdigest()[:15], 16) % sharding.SLOTS
    want = sorted(str((*r, slot(r), sharding.SHARDS[owner[slot(r)]])) for r in want)
    assert sorted(str(tuple(r)) for r in corpus_pipeline.run(spark, at).collect()) == want


def test_empty_tables(spark, tmp_path):
    for name, schema in SCHEMAS.items():
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    for name, query in [*catalog.QUERIES.items(), ("pipeline", corpus_pipeline.run)]:
        assert query(spark, str(tmp_path)).collect() == [], name


def test_classifier_learns_from_no_held_out_label(spark, folder):
    at, tables = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    s = subword.Settings("quality", lower=False, buckets=1 << 12, epochs=12)
    labels = spark.createDataFrame(tables["labels"], SCHEMAS["labels"])
    held = subword.held_out()
    turned = labels.selectExpr("doc_id", "1 - quality as quality", "toxic").where(held).unionByName(labels.where(~held | held.isNull()))
    found = subword.classify(docs, labels, s, 0.3).collect()
    assert sorted(map(str, found)) == sorted(map(str, subword.classify(docs.repartition(5), turned, s, 0.3).collect()))
    assert len(found) == len(tables["documents"]) and all(r["predicted"] == (r["score"] >= 0.3) for r in found)
    assert not any(r["held_out"] for r in found if r["doc_id"] is None)
    out = [r for r in found if r["held_out"] and r["doc_id"] < 60]
    assert sum((r["doc_id"] % 3 > 0) == (r["score"] > 0.5) for r in out) >= 0.9 * len(out) > 0
    one = labels.where("quality = 1")
    learned = len({r["doc_id"] for r in one.where(~held).collect()} & {r[0] for r in tables["documents"] if words_of(r[1])})
    (score,) = {r["score"] for r in subword.classify(docs, one, s, 0.3).collect()}
    assert score == pytest.approx((learned + 1) / (learned + 2), abs=0.01)
