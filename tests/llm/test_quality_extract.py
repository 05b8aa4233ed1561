import time
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import extract, quality

rng = random.Random(3)
WORDS = ["".join(rng.choice("aeiourstné") for _ in range(rng.randint(2, 8))) for _ in range(300)]


def clean(n):
    return " ".join(rng.choice(WORDS) + ("." if rng.random() < 0.1 else "") for _ in range(n)).capitalize()


def junk(n):
    kind = rng.randrange(3)
    if kind == 0:
        return " ".join(w + "***" for w in clean(n).split())
    return " ".join(w.upper() + "!!" for w in clean(n).split()) if kind == 1 else " ".join([rng.choice(WORDS)] * n)


@pytest.fixture(scope="module")
def corpus(spark):
    docs, labels = [], []
    for i in range(260):
        good = i % 3 > 0
        body = clean(rng.randint(60, 400)) if good else clean(15) + "\n" + junk(rng.randint(120, 300))
        docs.append((i, body))
        labels.append((i, int(good), 0))
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(corpus):
    docs, labels = corpus
    rows = quality.scored(docs, labels).join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    out = [r["predicted"] == r["quality"] for r in rows if r["held_out"]]
    assert np.mean(out) >= 0.9
    kept = quality.accepted(docs.withColumn("lang", F.lit("x")), labels)
    assert kept.columns == ["doc_id", "text", "lang"] and kept.count() == sum(r["predicted"] for r in rows)


def test_held_out_labels_don_t_matter(corpus):
    docs, labels = corpus
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r["doc_id"]: r["score"] for r in quality.scored(docs, x).collect()} for x in (labels, turned))
    assert a == b


def test_whole_texts_count():
    data = np.frombuffer(("a" * 3000).encode() + b"\xc3\xa9" * 700, np.uint8)
    chunks, first = quality.chunked(data, np.array([0, 0, 3000, 4400]))
    assert first.tolist() == [0, 1, 1 + 7, 8 + 3] and not chunks[0].any()
    assert set(chunks[1:7].ravel()) == {97} and set(chunks[8].tolist()) == {0xC3, 0xA9}


def plain(model, text):
    """The score of a text by a convolution in plain loops."""
    worst, total, many = -np.inf, 0.0, 0
    at = 0
    while True:
        piece = text[at : at + quality.CHUNK].ljust(quality.CHUNK, b"\0")
        tops = np.full(quality.FILTERS, -np.inf)
        for i in range(quality.CHUNK - quality.WIDTH + 1):
            seen = sum(model.table[k][piece[i + k]].astype(np.float64) for k in range(quality.WIDTH))
            tops = np.maximum(tops, seen)
        h = np.maximum(tops + model.bias, 0)
        z = float(np.maximum(h @ model.w1 + model.b1, 0) @ model.w2 + model.b2[0])
        worst, total, many = max(worst, z), total + z, many + 1
        if at + quality.CHUNK >= len(text):
            break
        at += quality.STEP
    return 1 / (1 + np.exp(model.pool[0] * worst + model.pool[1] * total / many + model.pool[2]))


def test_scores_equal_plain_loops(spark, corpus):
    model = quality.fitted(*corpus)
    texts = ["", "a", clean(40), junk(200), clean(100) + "\n" + junk(90), "é" * 256, "x" * 512, "x" * 513, "漢字 😀 " * 80]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in quality.scored(docs, corpus[1], model).collect()}
    for i, text in enumerate(texts):
        assert got[i] == pytest.approx(plain(model, text.encode()), abs=1e-4)


def test_long_texts_are_scored_in_pieces(corpus, monkeypatch):
    model = quality.fitted(*corpus)
    data = np.frombuffer((clean(4000) + junk(4000)).encode(), np.uint8)
    whole = quality._pooled(model, data, np.array([0, len(data)]))
    monkeypatch.setattr(quality, "GROUP", 5000)
    assert np.allclose(whole, quality._pooled(model, data, np.array([0, len(data)])), atol=1e-4)


def test_the_sample_is_bounded_and_whole(spark, corpus, monkeypatch):
    docs, labels = corpus
    texts, good = quality.sample(docs, labels)
    want = {r["doc_id"]: r["text"] for r in docs.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5}
    assert sorted(texts) == sorted(t.encode() for t in want.values()) and 0 < good.sum() < len(good)
    monkeypatch.setattr(quality, "TRAIN_BYTES", 20000)
    few, _ = quality.sample(docs, labels)
    assert set(few) < set(texts) and 15000 < sum(map(len, few)) <= 20000
    # Repeated and contradictory labels, and columns of clashing names: the sample stays bounded.
    twice = labels.unionByName(labels.withColumn("quality", 1 - F.col("quality"))).withColumns({"text": F.lit("t"), "_id": F.lit(1), "source": F.lit("s")})
    monkeypatch.setattr(quality, "TRAIN_ROWS", 30)
    assert len(quality.sample(docs.withColumns({"quality": F.lit(9), "_id": F.lit(2)}), twice)[0]) <= 60


def test_quality_of_odd_rows(spark, odd, nothing, corpus):
    labels = corpus[1]
    rows = quality.scored(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["held_out"] for r in rows if r["doc_id"] is None} == {False}
    assert quality.scored(nothing, labels).count() == 0
    assert {r["score"] for r in quality.scored(odd, labels.where(F.lit(False))).collect()} == {0.5}


def page(main, extra=""):
    return f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var a='</p>';</script></head><body><header>Site</header><nav><a href=x>menu</a></nav><div class='ad'>buy this</div>{main}{extra}<footer>&copy; x</footer></body></html>"


def test_extraction(spark):
    body = "<article><h1>Title &amp; more</h1><p>One <b>bold</b>\n word.<br>Next&nbsp;line<p>Two<ul><li>x<li>y</ul><form>mail <input></form><aside>side</aside></article>"
    text = "Title & more\nOne bold word. Next line\nTwo\nx\ny"
    long = "<div class='post-12'>" + "".join(f"<p>Paragraph {i} with some words in it.</p>" for i in range(9)) + "</div>"
    # A short text beside a long box without a telling name: only the host's other pages say which is the text.
    short = "<div class='post-77'><p>Short.</p></div><div class='box'><p>" + "filler words of some box " * 9 + "</p></div>"
    comments = "<section id='comments'><p>" + "a reader says something long " * 30 + "</p></section>"
    rows = [(1, "https://a.org/1", page(body)), (2, "http://u@a.org:80/2?x", page(body, comments)), (3, "https://b.net/1", page(long)), (4, "https://b.net/2", page(long)), (5, "https://b.net/3", page(short)), (6, None, None), (7, "x", ""), (8, "https://c.com", "plain <i>text</i> &eacute; &bad; <"), (9, "https://a.org/9", page("<article><p>open <b>tags</article>")[:-30])]
    got = {r["page_id"]: r for r in extract.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))).collect()}
    assert len(got) == 9 and got[1]["text"] == got[2]["text"] == text
    assert got[3]["text"].count("\n") == 8 and got[5]["text"] == "Short."
    assert got[6]["text"] == got[7]["text"] == "" and got[8]["text"] == "plain text é &bad; <" and got[9]["text"] == "open tags"
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert got[2]["host"] == "a.org" and got[6]["host"] == ""


def test_extraction_keeps_the_whole_article(spark):
    """A dominant part of an article is not taken for the article; a box beside it is no part of it."""
    most, rest = "<p>" + "most of the words stand here " * 20 + "</p>", "<p>" + "the rest stands here " * 8 + "</p>"
    words = lambda p: p[3:-4].strip()
    whole = ["T", "lead", words(most), words(rest)]
    cases = [
        (f"<article><h1>T</h1><p>lead</p><section class='a'>{most}</section><section class='b'>{rest}</section></article>", whole),
        (f"<article><h1>T</h1><p>lead</p><div class='entry-content'>{most}</div><div>{rest}</div></article>", whole),
        (f"<main><h1>T</h1><p>lead</p><table><tr><td>{most}</table><div>{rest}</div></main>", whole),
        (f"<div class='x'><h1>T</h1>lead<div class='body'>{most}</div>{rest}</div>", whole),
        (f"<p>Some word of the site.</p><article>{most}</article><div class='box'>{rest}</div>", whole[2:3]),
        (f"<div class='wrap'><a href=x>skip this</a><div class='y'>{most}</div></div><div class='box'>{rest}</div>", whole[2:3]),
    ]
    rows = [(10 * k + i, f"https://h{k}.org/{i}", page(main)) for k, (main, _) in enumerate(cases) for i in range(3)]
    got = {r["page_id"]: r["text"].split("\n") for r in extract.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {10 * k + i: want for k, (_, want) in enumerate(cases) for i in range(3)}


def test_extraction_heeds_what_names_say_of_the_page(spark):
    """Names of asides don't drop the article, nor what wraps nearly all text; true asides stay out."""
    text, some = "<h1>T</h1><p>" + "words of the article " * 20 + "</p>", "<p>said beside it</p>"
    cases = [f"<article class='post comments-open'>{text}</article>", f"<div class='content has-sidebar'>{text}</div>", f"<div class='page no-sidebar'>{text}</div>", f"<article class='social-story'>{text}</article>"]
    cases += [f"<div class='has-sidebar'>{text}<div class='sidebar'>{some}</div></div>", f"<div class='comments-open'>{text}<div id='comments'>{some}</div></div>", f"<div class='print-layout'><div id='search-view'>{text}</div></div>"]
    cases += [f"<div class='story legal'>{text}</div><div class='sidebar-content'>{some * 40}</div>", f"<article>{text}<article class='comment'>{some}</article></article><div class='related-posts'>{some * 90}</div>"]
    cases += [f"<div class='content'>{text}</div><div class='text' role='complementary'>{some}</div>"]
    rows = [(k, f"https://h{k}.org/", page(main)) for k, main in enumerate(cases)] + [(99, "https://x.org", page("<article></article>"))]
    got = {r["page_id"]: r["text"] for r in extract.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = "T\n" + ("words of the article " * 20).strip()
    assert got == {k: want for k in range(len(cases))} | {99: ""}


def test_extraction_of_nothing(spark):
    assert extract.main_texts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_wrappers_and_references():
    """A form around the page, a header in the text's element, references cut by tags, ends without beginnings."""
    long = "Sentence one of the article is here and long enough. " * 4
    assert extract.extract(f"<body><form action=x><div class='main'><h1>T</h1><p>{long}</p><input name=a></div></form></body>", []) == f"T\n{long.strip()}"
    assert extract.extract(f"<body><p>{long}</p><form>Your name <input> and address</form></body>", []) == long.strip()
    assert extract.extract(f"<body><div class='post'><header><h1>Title</h1></header><p>{long}</p></div></body>", []) == f"Title\n{long.strip()}"
    assert extract.extract(f"<p>&no<i>t;</i> a&amp;b {long}</p>", []) == f"&not; a&b {long.strip()}"
    began = time.time()
    assert extract.extract("<i>x" * 8000 + "</b>" * 8000, []) == "x" * 8000 and time.time() - began < 1
