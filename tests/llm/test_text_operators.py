"""BPE, language identification, toxicity, page extraction, Katz scores."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomtext.llm import bpe, katz, langid, mainhtml, ngramtables, toxicity
from loomtext.llm._shared import word_hashes

DOCS = "doc_id long, text string, ids string, score double, q int, n long"  # names that clash with columns of the operators
SF = "/root/testdata/sf0.001"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "x", 0.5, 1, None) for r in rows], DOCS)


def word(rng, letters="abcdefgh"):
    return "".join(rng.choice(letters) for _ in range(rng.randint(1, 6)))


ODD = [(1, None), (2, ""), (3, "a" * 70_000), (4, " \n\t "), (5, "tie tie tie"), (5, "tie tie tie"), (None, "no id"), (6, "Ünïcode 日本 😀 <|endoftext|> '")]


# words ---------------------------------------------------------------------
def test_word_hashes():
    texts = ["The the  THE", None, "", " x\x0by", "É é", "the"]
    hashes, starts = word_hashes(pa.array(texts))
    split = [re.findall("[^\x20\x09-\x0d]+", t or "") for t in texts]
    assert np.diff(starts).tolist() == [len(s) for s in split]
    flat = [w.replace("T", "t").replace("H", "h").replace("E", "e") if w.isascii() else w for s in split for w in s]
    assert len(set(zip(flat, hashes.tolist()))) == len(set(flat)) == len(set(hashes.tolist()))


# BPE -----------------------------------------------------------------------
def test_bpe_equals_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.vocabulary_path())
    rng = random.Random(1)
    parts = ["a", "B", "é", "<|endoftext|>", " ", "  ", "\n", "\t", "12", "\x1c", "　", "'s", "'", ".#", "\x85", "你好", "😀", "́", "꭬", "the word"]
    rows = ODD + [(10 + k, "".join(rng.choice(parts) for _ in range(rng.randint(0, 15)))) for k in range(300)]
    got = bpe.digests(docs(spark, rows)).collect()
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs(spark, rows[8:]))).collect()}
    assert back == {i: t for i, t in rows[8:]}


def test_bpe_splits_as_the_library(spark):
    with open(bpe.vocabulary_path(), encoding="utf-8") as f:
        codec = bpe.Codec(f.read())
    assert isinstance(codec.words, re.Pattern)  # twice as fast as ``regex``
    library = lambda t: [t[a:b] for _, (a, b) in codec.tokenizer.pre_tokenizer.pre_tokenize_str(t)]
    rng = random.Random(4)
    every = [chr(k) for k in range(bpe.LAST + 1)]
    texts = [t for c in every for t in (f"a {c}{c}b 1{c}", f"{c} {c}  x{c}", f"'s{c}'ll")]
    texts += ["".join(rng.choice(every if rng.random() < 0.5 else " \n\t'sdma1.\xa0") for _ in range(40)) for _ in range(3000)]
    for t in texts:
        assert codec.words.findall(t) == library(t), t


def test_bpe_words_are_encoded_once_and_join_their_groups(spark, monkeypatch):
    rng = random.Random(3)
    vocabulary = [word(rng) for _ in range(60)]
    rows = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 40)))) for k in range(300)]
    whole = sorted(bpe.digests(docs(spark, rows)).collect())
    monkeypatch.setattr(bpe, "GROUP_BYTES", 2000)
    assert sorted(bpe.digests(docs(spark, rows)).collect()) == whole
    source = bpe._source(spark, None)
    grouped = bpe._grouped(docs(spark, rows))
    assert grouped.select("part").distinct().count() >= 10 and grouped.count() == 300
    words = bpe._words(grouped, source)
    assert words.count() == words.distinct().count()
    found = bpe.word_table(words, source).collect()
    assert len(found) == words.count() and len({(r.word, bytes(r.ids)) for r in found}) == len({r.word for r in found})
    plan = bpe.digests(docs(spark, rows))._jdf.queryExecution().toString()
    assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning(word") >= 1 and "Exchange hashpartitioning(doc_id" not in plan


def test_bpe_groups_are_bounded_and_leave_no_table(spark):
    cores = spark.sparkContext.defaultParallelism
    text = "ab cd " * 50
    rows = [(k, text) for k in range(900)] + [(None, None), (901, "")]
    for given in (docs(spark, rows).coalesce(1), docs(spark, rows).coalesce(1).union(docs(spark, [(k, text) for k in range(1000, 1100)]).repartition(4))):
        size = given.selectExpr("sum(octet_length(text))").first()[0]
        found = bpe._grouped(given)
        groups = [r.n for r in found.groupBy("part").agg(F.sum(F.octet_length("text")).alias("n")).collect() if r.n]
        assert sorted(found.drop("part").collect(), key=str) == sorted(given.select("doc_id", "text").collect(), key=str)
        assert len(groups) >= cores and max(groups) <= 1.5 * size / cores + len(text)
    before = spark.catalog.listTables()
    assert bpe.digests(docs(spark, rows)).count() == len(rows)
    assert [t.name for t in spark.catalog.listTables()] == [t.name for t in before] and not any(t.name.startswith("grouped_") for t in before)


def test_bpe_empty(spark):
    assert bpe.digests(docs(spark, [])).count() == 0
    assert bpe.query(spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()


# language ------------------------------------------------------------------
def test_language_gradient():
    net = langid.Network(["a", "b", "c"])
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 256, (6, 5)), np.array([0, 1, 2, 0, 1])
    grad = net.gradients(x, y)[1]
    for k, g in grad.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        net.w[k][at] += 1e-3
        up = net.gradients(x, y)[0]
        net.w[k][at] -= 2e-3
        assert (up - net.gradients(x, y)[0]) / 2e-3 == pytest.approx(g[at], rel=0.02, abs=1e-6)
        net.w[k][at] += 1e-3


def test_language(spark):
    got = {r.doc_id: r for r in langid.query(spark, SF).collect()}
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = [i for i in truth if got[i].held_out]
    assert held == [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([got[i].lang_pred == truth[i] for i in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.lang_pred in set(truth.values()) for r in got.values())


def test_language_odd(spark):
    net = langid.Network(["de", "en"])
    got = langid.predict(docs(spark, ODD + [(7, "12 34 !")]), net).collect()
    assert len(got) == len(ODD) + 1
    by = {r.doc_id: r for r in got}
    assert {k for k, r in by.items() if r.lang_pred == "und"} == {1, 2, 4, 7} and by[1].score == 0
    assert len({(r.lang_pred, r.score) for r in got if r.doc_id == 5}) == 1
    one, whole = net.documents(pa.array(["ab" * 40_000])), net.positions(np.zeros((langid.SEGMENT, 1), np.uint8) + 97)
    assert one.shape == (1, 2) and whole.shape == (langid.SEGMENT, 2, 1) and one.sum() == pytest.approx(1)
    empty = docs(spark, []).withColumn("lang", F.lit("en"))
    assert langid.fit(empty) is None and langid.predict(empty, None).count() == 0
    assert langid.fit(docs(spark, ODD).withColumn("lang", F.lit(None).cast("string"))) is None
    assert {r.lang_pred for r in langid.predict(docs(spark, [(1, "abc")]), None).collect()} == {"und"}


def test_language_stage_keeps_clean(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet")
    extra = rows.limit(1).select(F.lit(-1).cast("long").alias("doc_id"), F.lit("123 --").alias("text"), "lang", "source", "n_chars")
    out = langid.stage(spark, rows.unionByName(extra), SF)
    ids = {r.doc_id for r in out.collect()}
    assert out.columns == rows.columns and -1 not in ids and len(ids) >= 0.99 * rows.count()


# toxicity ------------------------------------------------------------------
def test_toxicity_held_out(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for k in range(1500):
        bad = k % 5 == 0
        words = [word(rng, "abcdefghijk") for _ in range(rng.randint(5, 60))] + (["vile", "brute"] if bad else [])
        rng.shuffle(words)
        rows.append((k, " ".join(words)))
        labels.append((k, int(bad), 1))
    d, lab = docs(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int, text int")
    model = toxicity.fit(d.where("doc_id < 1000"), lab)
    got = {r.doc_id: r.score for r in toxicity.score(d, model).collect()}
    held = range(1000, 1500)
    assert np.mean([(got[k] >= 0.5) == (k % 5 == 0) for k in held]) > 0.97
    assert len(model[0]) < 2000  # the L1 term leaves few weights


def test_toxicity_ftrl_by_hand():
    m = toxicity.Ftrl()
    at = np.array([0, 7])
    for _ in range(3):
        m.learn(at, 1.0)
    z = n = zi = ni = 0.0
    for _ in range(3):
        w = 0.0 if abs(z) <= toxicity.L1 else -(z - math.copysign(toxicity.L1, z)) / ((toxicity.BETA + n**0.5) / toxicity.ALPHA + toxicity.L2)
        wi = -zi / ((toxicity.BETA + ni**0.5) / toxicity.ALPHA + toxicity.L2)
        g = 1 / (1 + math.exp(-(w + wi))) - 1
        z, n = z + g - ((n + g * g) ** 0.5 - n**0.5) / toxicity.ALPHA * w, n + g * g
        zi, ni = zi + g - ((ni + g * g) ** 0.5 - ni**0.5) / toxicity.ALPHA * wi, ni + g * g
    assert m.z[7] == pytest.approx(z) and m.z[0] == pytest.approx(zi)


def plain_toxicity(rows, labels):
    """Scores of all rows by the definition: features as tuples of words, a
    dictionary for each state, one coordinate at a time."""
    words = lambda t: [w for w in re.split("[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (t or "").lower()) if w]

    def tuples(t):
        w = words(t)
        return {(x,) for x in w} | {(g, *p) for g in (1, 2, 3) for p in zip(w, w[g:])}

    own = {i: tuples(t) for i, t in rows}
    # features share coordinates where their hashes do
    every = sorted(set().union(*own.values()), key=str)
    texts = [x[0] if len(x) == 1 else " ".join([x[1], *["x"] * (x[0] - 1), x[2]]) for x in every]
    index, of = toxicity.features(pa.array(texts))
    last = dict(zip(of.tolist(), index.tolist()))  # the widest gap comes last
    number = {x: last[k] for k, x in enumerate(every)}
    at = {i: sorted({0} | {number[x] for x in xs}) for i, xs in own.items()}
    learn = sorted((i, y) for i, y in labels if i in at and zlib.crc32(str(i).encode()) % 5)
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(k):
        free = toxicity.L1 if k else 0.0
        return 0.0 if abs(z[k]) <= free else -(z[k] - math.copysign(free, z[k])) / ((toxicity.BETA + n[k] ** 0.5) / toxicity.ALPHA + toxicity.L2)

    squash = lambda x: 1 / (1 + math.exp(-max(-35, min(35, x))))
    rng = np.random.default_rng(5)
    for _ in range(toxicity.EPOCHS):
        for j in rng.permutation(len(learn)):
            i, y = learn[j]
            w = {k: weight(k) for k in at[i]}
            g = squash(sum(w.values())) - y
            for k in at[i]:
                z[k] += g - ((n[k] + g * g) ** 0.5 - n[k] ** 0.5) / toxicity.ALPHA * w[k]
                n[k] += g * g
    return {i: squash(sum(weight(k) for k in ks)) for i, ks in at.items()}


def test_toxicity_against_plain_python(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    labels = [(r.doc_id, r.toxic) for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.toxic is not None]
    want = plain_toxicity(rows, labels)
    got = toxicity.query(spark, SF).collect()
    assert len(got) == len(rows)
    assert all(r.score == pytest.approx(want[r.doc_id], abs=1e-9) and r.predicted == (r.score >= 0.5) for r in got)


def test_toxicity_odd(spark):
    lab = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (5, None), (99, 1), (3, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs(spark, ODD), lab)
    got = toxicity.score(docs(spark, ODD), model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.fit(docs(spark, []), lab) is None and toxicity.fit(docs(spark, ODD), lab.limit(0)) is None
    assert toxicity.score(docs(spark, []), model).count() == 0
    assert {r.score for r in toxicity.score(docs(spark, ODD), None).collect()} == {0.0}
    out = toxicity.query(spark, SF)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"] and out.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


# pages ---------------------------------------------------------------------
PAGES = {
    "<html><body class='has-menu'><header><h1>Site</h1></header><div id=menu><ul><li><a href=x>Home</a><li><a href=y>News</a></ul></div>"
    "<div class=content><h2>Title &amp; more</h2><p>Long text, with  some\n words. And more of it, yes indeed, quite long; it goes on.<p>Short.<ul><li>one<li>two</ul>"
    "<p>Another long paragraph, with some words, and more.</div><div class='sidebar'>Read also this, that, more.</div><div class='comments'><p>Nice article, thank you, really.</p></div><footer>c</footer>": "Title & more\n\nLong text, with some words. And more of it, yes indeed, quite long; it goes on.\n\nShort.\n\none\n\ntwo\n\nAnother long paragraph, with some words, and more.",
    "<article><h1>T</h1><p>Body, text.</p><script>var a='</p>x';</script><aside>no</aside><div class='ad'>buy</div><p>End &lt;b&gt;.</article><p>after": "T\n\nBody, text.\n\nEnd <b>.",
    "": "",
    "<!-- only -->": "",
    "plain words, no markup": "plain words, no markup",
    "<p>un<b>cl<i>osed, text": "unclosed, text",
    "<a href='x'>a</a" + "<p>" * 3: "a",
}


def test_main_text():
    for page, text in PAGES.items():
        assert mainhtml.main_text(page) == text
    assert mainhtml.main_text(None) == ""
    long = "<article>" + "<p>some words, here.</p>" * 20_000 + "</article>"
    assert mainhtml.main_text(long).count("\n\n") == 19_999
    assert mainhtml.main_text("<" * 50_000) is not None


PROSE = [
    "The river rose over night, and by the morning the lower fields stood under water; nobody had seen it so high before.",
    "She asked him twice. He didn't answer, but went on writing, page after page, until the lamp went out.",
    "No.",
    "In the end it was the miller who spoke: the dam, he said, had been weak for years, and everybody knew it. Who was to blame?",
]


def test_paths_choose_what_is_kept(monkeypatch):
    p = "".join(f"<p>{x}</p>" for x in PROSE)
    want = "\n\n".join(PROSE)
    menu = "<table><tr><td>Home</td><td>News</td><td><a href='/'>Sport</a></td></tr></table>"
    pages = [
        f"<body><div>Buy two, get one. Only today!</div><div>{p}</div>{menu}</body>",
        f"<body><div>{''.join(f'<p>{x}</p>' for x in PROSE[:2])}<div>Buy two, get one. Only today!</div><table><tr><td class=navx>Home</td></tr></table>{''.join(f'<p>{x}</p>' for x in PROSE[2:])}</div></body>",
        f"<body><article class='post search'>{p}</article><div>Buy two, get one. Only today!</div></body>",
        f"<body><div class='post share-buttons-on'>{p}</div></body>",
        f"<body><article>{p}</article><section class=comments><p>{PROSE[0]}</p><p>{PROSE[1]}</p></section></body>",
        f"<body><main><h2>The flood</h2>{p}</main><div><h3>More</h3><a href='/x'>{PROSE[0]}</a></div></body>",
    ]
    wants = [want] * 5 + ["The flood\n\n" + want]
    assert [mainhtml.main_text(x) for x in pages] == wants
    rng = np.random.default_rng(0)
    for other in (lambda page: np.ones(len(page.blocks), bool), lambda page: rng.random(len(page.blocks)) < 0.5):
        monkeypatch.setattr(mainhtml, "selected", other)
        assert sum(mainhtml.main_text(x) != w for x, w in zip(pages, wants)) >= 4


def test_an_article_keeps_all_its_text():
    """Of an article only menus, adverts, comments and the like go, however short its blocks are."""
    long = "".join(f"<p>{x} {x}</p>" for x in PROSE[:2] + PROSE[3:])
    texts = [f"{x} {x}" for x in PROSE[:2] + PROSE[3:]]
    around = lambda inner: f"<body><nav><a href=/>Home</a></nav><div class=ad>Buy now, friends.</div><article>{inner}</article><aside>More.</aside></body>"
    more = {
        "<section><h2>Later</h2><p>It fell by three metres.</p></section>": ["Later", "It fell by three metres."],
        "<div>A paragraph in a div.</div>": ["A paragraph in a div."],
        "<figure><img src=x><figcaption>The mill, 1910</figcaption></figure>": ["The mill, 1910"],
        "<table><tr><th>Year</th><td>1910</td></tr></table>": ["Year", "1910"],
        "<details><summary>Notes</summary><p>Two dams</p></details>": ["Notes", "Two dams"],
    }
    for inner, blocks in more.items():
        assert mainhtml.main_text(around(long + inner)) == "\n\n".join(texts + blocks)
        assert mainhtml.main_text(around(inner + long)) == "\n\n".join(blocks + texts)
    header = "<header><h1>The flood</h1><p class=meta>By A. Miller</p></header>"
    assert mainhtml.main_text(around(header + long)) == "\n\n".join(["The flood", "By A. Miller", *texts])
    # a short article beside longer text that isn't one
    short = "<body><article><p>No.</p><p>Who was to blame?</p></article><div>" + long + "</div></body>"
    assert mainhtml.main_text(short) == "No.\n\nWho was to blame?"
    # what goes all the same
    junk = "<div class='share-buttons'>Share this, please.</div><ul><li><a href=/x>Another story, told here.</a></li></ul><form>Your name, please. <p>Yes.</p></form><section id=comments><p>Nice one, thank you.</p></section><p hidden>Not seen, at all.</p>"
    assert mainhtml.main_text(around(long + junk)) == "\n\n".join(texts)
    # a main of menus alone isn't the article
    assert mainhtml.main_text("<main><ul class=menu><li>One</li></ul></main><div>" + long + "</div>") == "\n\n".join(texts)


def test_a_form_around_the_page_is_no_form():
    long = "".join(f"<p>{x}</p>" for x in PROSE)
    page = f"<body><form id=aspnet action=x><input name=a><div><div class=nav>Home News</div><div>{long}</div></div></form></body>"
    assert mainhtml.main_text(page) == "\n\n".join(PROSE)
    assert mainhtml.main_text(f"<body><div>{long}</div><form><p>Leave a word, here. Thank you.</p></form></body>") == "\n\n".join(PROSE)


def test_ratios_by_hand():
    page = mainhtml.Page("<body><div><p>One, two.</p><p>Three <a href=x>four</a>!</p><ul><li>Five</li></ul><p class=ad>Six; seven.</p></div></body>")
    assert [b.text for b in page.blocks] == ["One, two.", "Three four!", "Five", "Six; seven."]
    size, marks, spread = mainhtml.ratios(page)
    lengths = {"p": [9, 7], "li": [4], "ad": [11]}  # without links
    mean = [8, 8, 4, 11]
    assert size.tolist() == mean and marks.tolist() == [1.5, 1.5, 0, 2] and spread.tolist() == [1, 1, 0, 0] and np.std(lengths["p"]) == 1
    path = np.array([b.path for b in page.blocks])
    w = lambda i, j: math.exp(-((i - j) ** 2) / 2) * (1 if path[i] == path[j] else mainhtml.STRANGE)
    by_hand = [sum(w(i, j) * mean[j] for j in range(4) if abs(i - j) < 3) / sum(w(i, j) for j in range(4) if abs(i - j) < 3) for i in range(4)]
    smoothed = mainhtml.smooth(size, path)
    assert np.allclose(smoothed, by_hand)
    punctuation = mainhtml.smooth(marks, path)
    fused = [smoothed[i] * math.log1p(punctuation[i] + 0.5) * (1 + math.log1p(spread[i])) for i in range(4)]
    value = [(fused[0] + fused[1]) / 2] * 2 + [fused[2], fused[3] * mainhtml.NAMED]
    limit = max(min(0.5 * np.std(value), max(value)), 0.15 * max(value))
    assert mainhtml.selected(page).tolist() == [v >= limit for v in value] == [True, True, False, False]


def test_deep_pages_take_time_in_proportion():
    import time

    def took(n):
        began = time.perf_counter()
        assert mainhtml.main_text("<div>" * n + "Some text, here." + "</b>" * n) == "Some text, here."
        assert mainhtml.main_text("".join(f"<div>text {k}, is here. " for k in range(n))).count("is here") == n
        return time.perf_counter() - began

    took(500)
    assert took(16_000) < 24 * took(2_000)


def test_main_text_query(spark):
    schema = "page_id long, url string, html string, text int, n_chars string"
    rows = [(1, "u", "<p>a, b.</p>", 1, "x"), (1, "u", "<p>a, b.</p>", 1, "x"), (None, None, None, None, None)]
    got = mainhtml.extract(spark.createDataFrame(rows, schema)).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, "u", "a, b.", 5)] * 2 + [(None, None, "", 0)], key=str)
    assert mainhtml.extract(spark.createDataFrame([], schema)).count() == 0
    # the article of the given pages, cut out by its tags
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in mainhtml.query(spark, SF).collect():
        inner = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        blocks = (re.sub(r"\s+", " ", __import__("html").unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " ")))).strip() for x in re.split(r"</?(?:p|h1)>", inner))
        assert r.text == "\n\n".join(x for x in blocks if x) and r.n_chars == len(r.text)


# Katz ----------------------------------------------------------------------
def katz_by_hand(rows, learn):
    up = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    texts = [(i, re.findall("[^\x20\x09-\x0d]+", (t or "").translate(up)) + ["</s>"], ok) for (i, t), ok in zip(rows, learn)]
    one, two, context, after = collections.Counter(), collections.Counter(), collections.Counter(), collections.defaultdict(set)
    for _, ws, ok in texts:
        for v, w in zip(["<s>", *ws], ws) if ok else ():
            one[w] += 1
            two[v, w] += 1
            context[v] += 1
            after[v].add(w)
    n, size = sum(one.values()), len(one)

    def discounts(counts):
        return katz.discounts(np.array([0] + [sum(c == r for c in counts) for r in range(1, katz.K + 2)]))

    d1, d2 = discounts(one.values()), discounts(two.values())
    kept = lambda c, d: c * (d[c] if c <= katz.K else 1.0)
    low = lambda w: kept(one[w], d1) / (n + 1)
    unknown = 1 - sum(low(w) for w in one)

    def back(v):
        if not context[v]:
            return 1.0
        return (1 - sum(kept(two[v, w], d2) for w in after[v]) / (context[v] + 1)) / (1 - sum(low(w) for w in after[v]))

    def p(v, w):
        if two[v, w]:
            return kept(two[v, w], d2) / (context[v] + 1)
        return back(v) * (low(w) if one[w] else unknown)

    for v in [*list(context)[:20], "never seen"]:
        assert sum(p(v, w) for w in one) + back(v) * unknown == pytest.approx(1)
    out = []
    for i, ws, _ in texts:
        base = sum(math.log10((one[w] + 1) / (n + size + 1)) for w in ws)
        out.append((str(i), len(ws), sum(one[w] > 0 for w in ws), n, base, sum(math.log10(p(v, w)) for v, w in zip(["<s>", *ws], ws))))
    return sorted(out)


@pytest.mark.parametrize("bucket,together", [(40_000_000, 100_000), (200, 7)])
def test_katz(spark, monkeypatch, bucket, together):
    monkeypatch.setattr(katz, "BUCKET_BYTES", bucket)
    monkeypatch.setattr(katz, "TOGETHER", together)
    rng = random.Random(4)
    vocabulary = [word(rng) for _ in range(300)]
    rows = [(100 + k, " ".join(vocabulary[min(int(rng.expovariate(0.02)), 299)] for _ in range(rng.randint(0, 60)))) for k in range(120)] + ODD + [(7, "The THE the the " * 300), (8, "some words"), (8, "other words, and more"), (None, None)]
    got = katz.score(docs(spark, rows), F.col("doc_id") % 3 != 0).collect()
    want = katz_by_hand(rows, [i is not None and i % 3 != 0 for i, _ in rows])
    got = sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got)
    assert len(got) == len(want)
    for r, w in zip(got, want):
        assert r[:4] == w[:4] and r[4] == pytest.approx(w[4]) and r[5] == pytest.approx(w[5])


def test_katz_without_training_or_rows(spark):
    assert katz.score(docs(spark, []), F.lit(True)).count() == 0
    got = katz.score(docs(spark, [(1, "a b"), (2, None)]), F.lit(False)).orderBy("doc_id").collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.score) for r in got] == [(3, 0, 0, 0.0), (1, 0, 0, 0.0)]


def test_katz_query(spark):
    got = katz.query(spark, SF).collect()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def tables_by_hand(rows, learn, order):
    """Scores of a back-off model of any order, by dictionaries and recursion."""
    up = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    texts = [(i, ["<s>"] * (order - 1) + re.findall("[^\x20\x09-\x0d]+", (t or "").translate(up)) + ["</s>"], ok) for (i, t), ok in zip(rows, learn)]
    grams = lambda ws, n: [tuple(ws[k - n + 1 : k + 1]) for k in range(order - 1, len(ws))]
    count = [None] + [collections.Counter(g for _, ws, ok in texts if ok for g in grams(ws, n)) for n in range(1, order + 1)]
    d = [None] + [katz.discounts(np.array([0] + [sum(c == r for c in x.values()) for r in range(1, katz.K + 2)])) for x in count[1:]]
    total, after = sum(count[1].values()), collections.defaultdict(set)
    for x in count[2:]:
        for g in x:
            after[g[:-1]].add(g[-1])
    size = {u: sum(count[len(u) + 1][u + (w,)] for w in ws) for u, ws in after.items()}

    def seen(g):
        c = count[len(g)][g]
        return c * (d[len(g)][c] if c <= katz.K else 1.0) / ((size[g[:-1]] if len(g) > 1 else total) + 1)

    unknown = 1 - sum(seen(g) for g in count[1])

    def back(u):
        return (1 - sum(seen(u + (w,)) for w in after[u])) / (1 - sum(seen(u[1:] + (w,)) for w in after[u])) if u in size else 1.0

    def p(g):
        if count[len(g)][g]:
            return seen(g)
        return back(g[:-1]) * p(g[1:]) if len(g) > 1 else unknown

    for u in [*list(size)[::40], ("never",) * (order - 1)]:  # a distribution for every context
        assert sum(p(u + g) for g in count[1]) + p(u + ("unknown word",)) == pytest.approx(1)
    out = [(str(i), len(ws) - order + 1, sum(math.log10(p(g)) for g in grams(ws, order))) for i, ws, _ in texts]
    return sorted(out)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_ngram_tables(spark, order, tmp_path):
    rng = random.Random(order)
    vocabulary = [word(rng) for _ in range(40)]
    rows = [(100 + k, " ".join(vocabulary[min(int(rng.expovariate(0.2)), 39)] for _ in range(rng.randint(0, 60)))) for k in range(120)] + ODD + [(7, "The THE the the " * 300), (8, "some words"), (8, "other words, and more"), (None, None)]
    given = docs(spark, rows)
    learn = F.coalesce(F.col("doc_id") % 3 != 0, F.lit(False))
    model = ngramtables.train(given.where(learn), order)
    model.save(str(tmp_path / "m"))
    model = ngramtables.Model.load(spark, str(tmp_path / "m"))
    got = ngramtables.evaluate(given, model).collect()
    want = tables_by_hand(rows, [i is not None and i % 3 != 0 for i, _ in rows], order)
    plain = sorted((str(r.doc_id), r.n_tokens, r.score) for r in got)
    assert len(plain) == len(want)
    for r, w in zip(plain, want):
        assert r[:2] == w[:2] and r[2] == pytest.approx(w[2], abs=1e-6)
    if order == 2:  # the query's operator gives the same
        same = {(str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), round(r.score, 5)) for r in katz.score(given, learn).collect()}
        assert same == {(str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), round(r.score, 5)) for r in got}
    if order == 3:  # the tables can be asked: what follows "the the", and how often
        h = lambda *x: spark.range(1).select(F.xxhash64(*x)).first()[0]
        the = h(F.lit("the"))
        pair = h(F.lit(the), F.lit(the))
        asked = {r.term: r["count"] for r in model.grams.where((F.col("n") == 3) & (F.col("context") == pair)).join(model.terms, "word").collect()}
        assert asked == {"the": 1198}


def test_ngram_tables_empty(spark):
    model = ngramtables.train(docs(spark, []), 3)
    assert ngramtables.evaluate(docs(spark, []), model).count() == 0
    got = ngramtables.evaluate(docs(spark, [(1, "a b"), (2, None)]), model).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_tokens, r.n_known, r.score) for r in got] == [(1, 3, 0, 0.0), (2, 1, 0, 0.0)]
