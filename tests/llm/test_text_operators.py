"""Text operators against plain versions on small fixtures with nulls, empty texts, repeats and clashing columns."""

import hashlib
import math
import random
import re
import time
import xml.etree.ElementTree as ElementTree
from fractions import Fraction
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.llm import decontaminate, html_text, jaccard_join, licenses, masked_lm, mixing, quality_rules, sharding, subword
from strandlake.llm.fm_index import FMIndex, suffix_array

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string"


def prose(rng, n):
    return " ".join(rng.choice(["the", "of", "contig", "read", "Gap", "mapping", "é", "x1", "tag"]) + rng.choice(["", "s", ","]) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    out = [None, "", "  \n", "one two", "a " * 40, prose(rng, 4000)]
    out += [prose(rng, rng.randint(5, 120)) for _ in range(30)]
    out += [out[7], out[7] + " more", out[8].replace("read", "reads", 1), "licensed under the MIT\nLicense, or the Apache License"]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i if i != 9 else None, t, "en", [None, "a", "b", "b"][i % 4], None, "clash") for i, t in enumerate(texts)] + [(3, "one two", "en", "a", None, "clash")]
    return spark.createDataFrame(rows, SCHEMA)


def folded(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def test_fm_index_finds_every_place():
    rng = np.random.RandomState(1)
    seq = rng.randint(0, 4, 400)
    assert list(suffix_array(np.append(seq + 1, 0))) == sorted(range(401), key=lambda i: [*(seq[i:] + 1), 0])
    index = FMIndex(seq, 4, 5)
    patterns = np.array([seq[i : i + 3] for i in range(0, 390, 7)])
    low, high = index.search(patterns)
    for p, a, b in zip(patterns, low, high):
        assert sorted(index.locate(np.arange(a, b))) == [i for i in range(398) if list(seq[i : i + 3]) == list(p)]


def test_decontamination(spark, docs, texts):
    items = [("i1", texts[10]), ("i2", "One two"), ("i3", None), ("i4", ""), ("i1", texts[10]), (None, texts[12])]
    bench = spark.createDataFrame(items, "item_id string, text string")
    windows = {tuple(w[i : i + 10]) for _, t in items for w in [folded(t)] if w for i in range(max(1, len(w) - 9))}
    for size in (3000, 64_000_000):
        found = {(r["doc_id"], r["text"]): r for r in decontaminate.find(docs, bench, shard_rows=7, block_bytes=size).collect()}
        for text in texts:
            w, hit = folded(text), set()
            for x in windows:
                for i in range(len(w) - len(x) + 1):
                    if tuple(w[i : i + len(x)]) == x:
                        hit |= set(range(i, i + len(x)))
            row = next(r for (_, t), r in found.items() if t == text)
            assert row["__words"] == len(w) and (decontaminate.NO_ID in row["__items"]) == (text == texts[12])
            assert {k for s in row["__spans"] for k in range(s["first"], s["last"] + 1)} == hit
    loud = spark.createDataFrame([(1, "Before, ONE Two! After", "en", "a", 22, "x")], SCHEMA)
    assert [(r["text"], r["n_chars"]) for r in decontaminate.clean(loud, bench).collect()] == [("Before, ! After", 15)]
    clean = decontaminate.clean(docs, bench)
    assert clean.columns == docs.columns
    assert not [r for r in decontaminate.find(clean, bench).collect() if r["__spans"] and r["text"] in texts]


def test_jaccard_groups(spark, docs, texts):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := folded(t)) else frozenset() for _, t in rows]
    links, root = [0] * len(rows), list(range(len(rows)))
    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and Fraction(len(sets[a] & sets[b]), len(sets[a] | sets[b])) >= Fraction(4, 5):
            links[a] += 1
            links[b] += 1
            old, new = root[b], root[a]
            root = [new if r == old else r for r in root]
    ids = [min((rows[j][0] for j in range(len(rows)) if root[j] == root[i] and rows[j][0] is not None), default=None) for i in range(len(rows))]
    want = sorted((str(rows[i][0]), str(ids[i]), links[i]) for i in range(len(rows)))
    got = sorted((str(r["doc_id"]), str(r["class_id"]), r["n_links"]) for r in jaccard_join.grouped(docs, block=4).collect())
    assert got == want
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({root[i] for i in range(len(rows)) if sets[i]}) + sum(not s for s in sets)


def largest_share(df, where):
    """The rows that the fullest task of the shuffles of ``df`` reads, over all rows, by the sizes of its partitions."""
    sizes = df.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert sizes, where
    return max(r["count"] for r in sizes) / sum(r["count"] for r in sizes)


@pytest.mark.parametrize("ids", ["null", "one"])
def test_rows_without_ids_of_their_own(spark, texts, ids, monkeypatch):
    """Nine rows of ten without an id, or one id for all: same results as with ids, and no task that gets them all."""
    rng = random.Random(7)
    some = [prose(rng, rng.randint(12, 40)) for _ in range(200)]
    given = [(i if ids == "null" and i % 10 == 0 else None if ids == "null" else 5, t, "en", "a", None, "x") for i, t in enumerate(some + some[:40])]
    docs = spark.createDataFrame(given, SCHEMA)
    groups = jaccard_join.grouped(docs, block=4)
    assert groups.count() == 240 and groups.where("n_links > 0").count() == 80 and groups.select("group").distinct().count() == 200
    assert jaccard_join.keep_one(docs).select("text").distinct().count() == jaccard_join.keep_one(docs).count() == 200
    labels = spark.createDataFrame([(0, 1), (5, 1)], "doc_id long, quality int")
    counts = quality_rules.bucket_counts(docs, labels, 1 << 16)
    words = sum(2 * len(t.split()) - 1 for t in some + some[:40])
    trusted = words if ids == "one" else sum(2 * len(t.split()) - 1 for t in some[:1])
    assert (sum(r for _, r, _ in counts), sum(t for *_, t in counts)) == (words, trusted)
    mixed = mixing.plan(docs.select("doc_id", "source", mixing.words_in("text").alias("size")))
    assert mixed.count() == 240
    bench = spark.createDataFrame([(1, " ".join(some[3].split()[:12]))], "item_id long, text string")
    assert decontaminate.find(docs, bench).where("size(__spans) > 0").count() == 2
    if ids == "one":
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        good = spark.createDataFrame([(5,)], "doc_id long").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(quality_rules.SALTS - 1))))
        salted = docs.withColumn("__salt", F.pmod(F.xxhash64("text"), F.lit(quality_rules.SALTS)).cast("int"))
        share = largest_share(salted.join(good.hint("shuffle_hash"), ["doc_id", "__salt"], "left_semi"), "quality rules")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert share < 0.35


def test_blocks_are_searched_in_one_stage(spark, docs, texts):
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(texts) if t], "item_id long, text string")
    one, many = (decontaminate.find(docs, bench, block_bytes=size) for size in (64_000_000, 20_000))
    assert many._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))


def test_a_repeated_id_gives_one_labelled_row(spark):
    s = subword.Settings("toxic", lower=True, buckets=1 << 10, epochs=2)
    docs = spark.createDataFrame([(1, f"text {i % 3}") for i in range(90)] + [(2, "other"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (1, 1)], "doc_id long, toxic int")
    held = {r["doc_id"] for r in docs.where(subword.held_out()).select("doc_id").distinct().collect()}
    found = subword.sample(docs, labels, s)
    assert found.num_rows == len({1, 2} - held)


def test_pruning_bound_is_the_posterior():
    r = 0.8 + 0.2 / 256
    for n, m in zip(range(16, 129, 16), jaccard_join.least_matches(Fraction(4, 5), 1e-9)):
        tail = lambda m: sum(math.comb(n + 1, k) * r**k * (1 - r) ** (n + 1 - k) for k in range(m + 1))
        assert tail(m) >= 1e-9 and (m == 0 or tail(m - 1) < 1e-9)


def test_quality_rules(spark, docs, texts):
    labels = spark.createDataFrame([(6, 1, 0), (7, 1, 0), (6, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    for r in quality_rules.judge(docs, labels).select("doc.text", "*").collect():
        text = r["text"] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        five = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        hit = {k for i, x in enumerate(five) if five.count(x) > 1 for k in range(i, i + 5)} if len(w) < 500 else None
        lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
        assert (r["n_words"], r["word_chars"], r["n_dup_lines"]) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)))
        if hit is not None:
            assert r["n_repeat_words"] == len(hit)
            assert r["base_failed"] == (len(w) < 10 or 100 * len(hit) > 20 * len(w))


def test_quality_rules_count_every_trusted_text(spark):
    docs = spark.range(60_000).selectExpr("id as doc_id", "'word' as text")
    labels = spark.range(55_000).selectExpr("id as doc_id", "1 as quality")
    assert [(r, t) for _, r, t in quality_rules.bucket_counts(docs, labels.union(labels), 1 << 16)] == [(60_000, 55_000)]
    assert quality_rules.judge(docs.limit(10), labels).where("kept").count() == 0  # too short, whatever the score


def test_lookup_table_is_filled_in_turns():
    names, slots = [f"s{i}" for i in range(5)], 23
    number = lambda name, part: int(hashlib.md5(f"{part}:{name}".encode()).hexdigest(), 16)
    orders = [[(number(s, "offset") % slots + j * (number(s, "skip") % (slots - 1) + 1)) % slots for j in range(slots)] for s in names]
    want: dict[int, int] = {}
    while len(want) < slots:
        for k, order in enumerate(orders):
            if len(want) < slots:
                want[next(s for s in order if s not in want)] = k
    assert sharding.fill(names, slots) == [want[s] for s in range(slots)]
    with pytest.raises(ValueError):
        sharding.fill(names, 24)


def test_mixing_meets_targets(spark, docs):
    rows = mixing.plan(docs.select("doc_id", "source", mixing.words_in("text").alias("size"))).collect()
    assert len(rows) == docs.count() and all(0 <= r["copies"] <= 3 for r in rows)
    for source in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == source]
        assert abs(sum(r["copies"] * r["size"] for r in own) - own[0]["target"]) <= 2 * max(r["size"] for r in own) + 1
    assert mixing.mix(docs).columns == docs.columns
    assert mixing.mix(docs).count() == sum(r["copies"] for r in rows)


def test_article_text():
    page = ("<html><body><nav><a href=x>Menu</a></nav><div class='cookie-notice'>We use cookies</div><article><h1>Title &amp; more</h1>"
            "<p>First  <b>bold</b>\n text<br><p>Second &lt;x&gt; paragraph that is a good deal longer.</p><div class='comments'><p>Nice!</p></div></article>"
            "<aside>See also</aside><footer>&copy; me</footer>")
    assert html_text.article(page) == "Title & more\nFirst bold text\nSecond <x> paragraph that is a good deal longer."
    assert html_text.article(None) == html_text.article("") == ""


PROSE = "This is a good deal of plain text in one paragraph, long enough to count as prose. " * 3


@pytest.mark.parametrize("html, text", [
    (f"<body><div class='layout has-sidebar'><p>{PROSE}</p></div></body>", PROSE),
    (f"<article class='post comments-open'><p>{PROSE}</p><div id=comments><p>{PROSE[:60]}</p></div></article>", PROSE),
    (f"<article><p>{PROSE}</p><section id='related-work'><h2 id=related-work>Related work</h2><p>x <math><mi>y</mi></math></p></section></article>", PROSE + "\nRelated work\nx y"),
    (f"<div class='cookie-notice'>Cookies!</div><div><h1>T</h1><p>{PROSE}<p>{PROSE}</div><div class='site-footer'>foot</div><ul role=menu><li>m</ul>", f"T\n{PROSE}\n{PROSE}"),
    (f"<header><h1>Site</h1></header><article><header><h1>T</h1></header><p>{PROSE}</p><footer>f</footer></article>", f"T\n{PROSE}"),
    (f"<div><a href=1>{PROSE}</a><a href=2>{PROSE}</a></div><div><p>{PROSE}</p><p>{PROSE}</p></div>", f"{PROSE}\n{PROSE}"),
    (f"<form><input>{PROSE}</form><script>var t='</p>'</script><style>p</style><p>a<br>b&amp;c&#x41;&nbsp; d</p>", "a b&cA d"),
    (f"<p>hello</p><![ x]><![foo[x]]><!-- <p>no</p> --><? no ?></ no><p title=\"open>{PROSE}</p><p>end", f"hello\n{PROSE}\nend"),
    ("<div>  </div>", ""), ("<head><title>x</title><p>abc", "abc"), ("1 < 2", "1 < 2"),
])
def test_article_choice(html, text):
    assert html_text.article(html) == re.sub(" +\n", "\n", text).strip()


WHOLE = f"<h1>Title</h1><p>{PROSE}</p><p>Short one.</p><p>{PROSE}</p>"


@pytest.mark.parametrize("html", [
    f"<body><form id='aspnetForm'><div><a href=1>Home</a></div><div>{WHOLE}</div><input><select><option>a</select><button>Go</button><footer><p>f</p></footer></form></body>",
    f"<body><nav><ul><li><a href=1>Home</a><li><a href=2>More</a></ul><article>{WHOLE}</article></body>",
    f"<body><dialog open><article>{WHOLE}</article></dialog></body>", f"<div role='dialog'>{WHOLE}</div>", f"<aside>{WHOLE}</aside>", f"<header>{WHOLE}</header><footer>f</footer>",
    f"<article>{WHOLE}</article><dialog><p>We use cookies for many good things. Do you accept them all?</p></dialog>",
    f"<div>{WHOLE}</div><form><label>Name</label><input><p>Please fill in this form.</p></form><nav><p>Menu</p></nav>",
])
def test_no_cut_takes_the_page(html):
    assert html_text.article(html).split("\n") == ["Title", PROSE.strip(), "Short one.", PROSE.strip()]


def plain_article(html):
    """Densities by recursion over a well-formed page of div, p, h2, a, b and span elements."""
    top = ElementTree.fromstring(html)
    kids = lambda e: list(e)
    texts = lambda e: [t for t in [e.text, *(c.tail for c in e)] if t]
    chars = lambda e: sum(len(" ".join(t.split())) for t in texts(e)) + sum(map(chars, kids(e)))
    tags = lambda e: sum(tags(c) + (c.tag not in ("b", "span")) for c in kids(e))
    links = lambda e: chars(e) if e.tag == "a" else sum(map(links, kids(e)))
    link_tags = lambda e: sum(link_tags(c) + (c.tag == "a") for c in kids(e))

    def density(e):
        c, t, lc = chars(e), max(1, tags(e)), links(e)
        if not c:
            return 0.0
        base = math.log(c / max(1, c - lc) * lc + links(top) / chars(top) * c + math.e)
        ratio = max(1.0, c / max(1, lc) * t / max(1, link_tags(e)))
        return c / t * (math.log(ratio, base) if base > 1 else math.log(ratio))

    total = lambda e: max(sum(map(density, kids(e))), density(e) if any(not t.isspace() for t in texts(e)) else 0.0)
    parent = {c: e for e in top.iter() for c in e}
    core = max(top.iter(), key=total)
    path = [core]
    while path[-1] is not top:
        path.append(parent[path[-1]])
    least = min(map(density, path))
    out, line = [], []

    def end():
        if text := " ".join("".join(line).split()):
            out.append(text)
        line.clear()

    alone = not any(c is not core and c not in path and (density(c) >= least > 0 or c.tag in ("h2", "a", "b", "span")) for e in path[1:] for c in e) and core is not top

    def walk(e, inside):
        inside = inside or e is core or (e not in path and (density(e) >= least > 0 or e.tag in ("h2", "a", "b", "span")))
        if not inside and e not in path:
            return
        block = e.tag in ("div", "p", "h2", "body")
        if block:
            end()
        own = inside or not alone
        line.append(e.text if own and e.text else "")
        for c in e:
            walk(c, inside)
            line.append(c.tail if own and c.tail else "")
        if block:
            end()

    walk(top, False)
    return "\n".join(out)


def test_densities_are_the_plain_ones():
    rng = random.Random(12)
    say = lambda n: " ".join(rng.choice(["alpha", "beta,", "gamma", "delta"]) for _ in range(n))

    def part(depth):
        kind = rng.choice(["p", "p", "p", "h2", "links", "div", "div"]) if depth else rng.choice(["p", "links"])
        if kind == "p":
            return f"<p>{say(rng.randint(1, 60))}" + (f" <b>{say(3)}</b> <a>{say(2)}</a> {say(4)}" if rng.random() < 0.4 else "") + "</p>"
        if kind == "h2":
            return f"<h2>{say(3)}</h2>"
        if kind == "links":
            return "<div>" + "".join(f"<span><a>{say(2)}</a></span> " for _ in range(rng.randint(1, 8))) + "</div>"
        return "<div>" + "".join(part(depth - 1) for _ in range(rng.randint(1, 5))) + "</div>"

    for _ in range(300):
        page = "<body>" + "".join(part(3) for _ in range(rng.randint(1, 5))) + "</body>"
        assert html_text.article(page) == plain_article(page), page


def test_broken_pages_take_linear_time_and_never_fail():
    n = 20_000
    for page in ("<article>" + "<header>" * n + "x" + "</header>" * n, "<div>" * n + "x" + "</span></p>" * n, "<li><ul>" + "<div>" * n + "<li></li>" * n, "<" * n, "<a " * n, '<a b="' * n + "x", "<!--" * n, "<a" + " " * n, "<p>" * n):
        began = time.time()
        html_text.article(page)
        assert time.time() - began < 3
    rng = random.Random(4)
    bits = ["<", ">", "/", "!", "[", "]", "--", '"', "'", "=", "a", "div", "p", "li", "td", "script", "article", " ", "&#x;", 'class="ad"', "text ", "<p>", "</p>", "<![", "<?", "head"]
    for _ in range(2000):
        html_text.article("".join(rng.choice(bits) for _ in range(rng.randint(1, 40))))


def test_licence_places(spark):
    rng = random.Random(5)
    texts = [None, "", "MIT license"] + [" ".join(rng.choice(["mit", "MIT", "license", "Apache", "general", "public", "x", "-"]) for _ in range(rng.randint(1, 400))) for _ in range(40)]
    texts.append("SPDX-License-Identifier: MIT OR Apache-2.0 here\n" * 3000)
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, texts[2], 1)], "doc_id long, text string, n_words long")
    for r in licenses.scan(docs).collect():
        w = folded(texts[r["doc_id"] if r["doc_id"] is not None else 2])
        places, labels = [], set()
        for phrase, label in licenses.BASE.items():
            p = phrase.split()
            found = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
            places, labels = places + found, labels | ({label} if found else set())
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(places), min(places, default=None), max(places, default=None))
        assert r["base_labels"] == ",".join(sorted(labels)) and labels <= set(r["labels"].split(","))
    last = next(r for r in licenses.scan(docs).collect() if r["doc_id"] == len(texts) - 1)
    assert (last["labels"], last["score"]) == ("apache-2.0,mit", 1.0)


def test_licence_expressions(spark, docs):
    assert licenses.postfix("MIT OR Apache-2.0 AND (GPL-2.0 WITH Classpath-exception-2.0)") == [
        "mit", "apache-2.0", "gpl-2.0", "classpath-exception-2.0", "with", "and", "or"]
    assert licenses.evaluate("GPL-3.0 AND MIT")[1] == licenses.freedom("gpl-3.0")
    assert licenses.evaluate("MIT AND")[1] == 0.5 and licenses.postfix("(MIT") is None
    row = next(r for r in licenses.scan(docs).collect() if r["n_base"] == 2)
    assert (row["first_word"], row["last_word"], row["base_labels"]) == (3, 7, "apache,mit")


def test_masked_lm_is_a_distribution(spark, docs, texts):
    cell, n = np.array([5, 9, 40]), np.array([3, 1, 7])
    assert np.allclose(np.exp(masked_lm.train(cell, n, 2, 3, epochs=2)).sum(1), 1, atol=1e-4)
    rows = masked_lm.score(docs, 50, 3, 4).collect()
    assert len(rows) == docs.count()
    assert all(r["score"] is None and r["log_prob"] == 0 if r["n_tokens"] == 0 else r["score"] < 0 for r in rows)


def test_masked_lm_sees_words(spark, monkeypatch):
    monkeypatch.setattr(masked_lm, "BATCH", 16)
    long = "x" * 70
    pairs = [(i, f"a{i} b{i}") for i in range(30)] * 200 + [(100 + i, f"a{i} b{(i + 7) % 30}") for i in range(30)]
    some = spark.createDataFrame([*pairs, (200, long), (201, "once"), *[(300, long)] * 50], "doc_id long, text string")
    found = {r["doc_id"]: r["score"] for r in masked_lm.score(some, every=1).collect()}
    assert min(found[i] for i in range(30)) > max(found[100 + i] for i in range(30)) + 1  # all words are equally frequent
    assert found[200] == found[300] > found[201] + 1
    again = {r["doc_id"]: r["score"] for r in masked_lm.score(some.orderBy("text").repartition(7), every=1).collect()}
    assert again == pytest.approx(found, abs=1e-5)
    mixed = {r["doc_id"]: r["score"] for r in masked_lm.score(some, every=1, block=4000).collect()}  # copies of a text share a part
    assert mixed != found and np.mean([mixed[i] for i in range(30)]) > np.mean([mixed[100 + i] for i in range(30)]) + 1


def test_masked_lm_scores_are_the_products_of_turns():
    words = masked_lm.Words([("a", 5), ("b", 3), ("c", 3)], [(0, 2, 2), (1, 1, 1)], 2)
    network = masked_lm.Network(6, words.counts, 3, 4)
    network.start()
    rng = np.random.RandomState(2)
    texts = [b"a b c a z y", b"", None, b"c"]
    ids, place, sizes = words.tokens(texts)
    network.learn(words.around(ids, place, sizes, np.arange(len(ids))), ids, rate=0.5)
    got = network.log_prob(words.around(ids, place, sizes, np.arange(len(ids))), ids)
    embedding, inner, shift, vectors, bias = (p.astype(float) for p in network.params)
    at = 0
    for text in texts:
        own = [words.leaf(w) for w in text.split()] if text else []
        for i, leaf in enumerate(own):
            around = [own[i + p] if 0 <= i + p < len(own) else 5 for p in masked_lm.PLACES]
            h = np.tanh(np.concatenate([embedding[a] for a in around]) @ inner + shift)
            total = 0.0
            for node, turn in list(zip(network.nodes, network.turns))[network.begins[leaf] : network.begins[leaf + 1]]:
                total -= math.log1p(math.exp(-turn * (h @ vectors[node] + bias[node])))
            assert got[at] == pytest.approx(total, abs=1e-4)
            at += 1
    assert at == len(ids)
    everything = [network.log_prob(np.array([[1, 2, 3, 5]]), np.array([leaf]))[0] for leaf in range(5)]
    assert sum(np.exp(everything)) == pytest.approx(1, abs=1e-5)


def test_masked_lm_learns_from_more_of_more_documents(spark, docs):
    def gathered(rows):
        words = masked_lm.learn_words(rows, 5)
        assert words.counts.sum() == sum(r["n"] for r in masked_lm.word_counts(rows).collect())
        return masked_lm.windows_of(rows, spark.sparkContext.broadcast((words, None)), 2).count()

    assert gathered(docs.union(docs)) == 2 * gathered(docs) > 0


def test_masked_lm_learns_from_every_window(spark, docs, monkeypatch):
    taken, learn = [], masked_lm.learn
    monkeypatch.setattr(masked_lm, "learn", lambda rows, words, network, every, block: taken.append(
        (masked_lm.windows_of(rows, spark.sparkContext.broadcast((words, None)), every).count(), words.counts.sum())) or learn(rows, words, network, every, block))
    masked_lm.score(docs, 50, 3, 4)
    assert taken[0][0] == taken[0][1] > 0
    found = [np.arange(n * 5).reshape(n, 5) + k * 1_000_000 for k, n in enumerate((3, 70_000, 0, 140_001))]
    steps = list(masked_lm.steps_of(found))
    assert {len(s) for s in steps[:-1]} == {masked_lm.BATCH} and np.array_equal(np.sort(np.concatenate(steps), 0), np.sort(np.concatenate(found), 0))


def test_misspelling_shares_subwords():
    s = subword.Settings("toxic", lower=True, buckets=1 << 12, epochs=20)
    rng = random.Random(1)
    rows = [(y, (w := ["worthless"] * y + [rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(6)]), [1] * len(w)) for y in (0, 1) * 60]
    score = subword.Scorer(*subword.train(rows, s), s)
    bad, good, empty = score(["alpha worthles beta", "alpha beta gamma", None])
    assert bad > 0.5 > good and 0 < empty < 1
