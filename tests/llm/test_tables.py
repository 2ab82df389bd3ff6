"""Operators over conversations, pages and embeddings, and the pipeline."""

import base64
import hashlib
import io
import struct
import tracemalloc
import zipfile

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from terraloom.llm import chat, html, queries, search, toxicity, warc

# --- chat -------------------------------------------------------------------------

SAID = "</s>[INST] ok [/INST]"


def by_conv(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in df.collect()}


def test_conversations_read_back(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = brute.chat([*rows, (-1, 0, "user", SAID), (-1, 1, "assistant", SAID)])
    assert by_conv(queries.op3_chat_formatting(spark, sf)) == want


def odd_turns():
    rows = [(1, 0, "system", "be kind"), (1, None, "user", None), (1, 2, None, "who?"), (1, 2, "assistant", "x\\<|end|>\\"), (1, 2, "assistant", "x\\<|end|>\\"),
            (None, 0, "user", "hi"), (None, 1, "assistant", "<|turn|>user<|says|>" + SAID), (2, 1, "assistant", "long " * 3000), (3, 0, "user", "")]
    rows += [(4, k, ("user", "assistant")[k % 2] if k else "system", f"turn {k} " + "word " * (k % 90)) for k in range(400)]
    return rows


@pytest.mark.parametrize("budget,history", [(512, 128), (64, 16), (40, 0), (10, 200)])
def test_odd_turns_read_back(spark, budget, history):
    d = spark.createDataFrame([(*r, "x") for r in odd_turns()], "conv_id long, turn int, role string, text string, window string")
    w = chat.windows(d, budget, history)
    assert by_conv(chat.digests(w)) == brute.chat(odd_turns())
    rows = w.where("conv_id = 4").orderBy("window").collect()
    tokens = lambda s: -(-len(s.encode()) // 4)
    for r in rows:
        said = chat._TURN.findall(r.formatted)
        assert len(said) == r.n_turns > r.new_from and said[0][0] == "system"
        cost = [tokens(a + b) + 4 for a, b in said]
        new = sum(cost[r.new_from :])
        assert new <= max(1, budget - history - cost[0]) or r.n_turns - r.new_from == 1 or r.new_from == 0
        assert sum(cost[1 : r.new_from]) <= history
        for a, b in zip(r.loss[::2], r.loss[1::2], strict=True):
            assert r.formatted[:a].endswith("assistant" + chat.SAYS) and r.formatted[b:].startswith(chat.END)


def test_no_turns(spark):
    d = spark.createDataFrame([], "conv_id long, turn int, role string, text string")
    assert chat.digests(chat.windows(d)).count() == 0


# --- pages ------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body>
<header><h1>Site name</h1></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="cookie-notice">We use cookies.</div>
<div id="main"><article><h1>Title &amp; more</h1><p>First  paragraph, with <b>bold</b> and&nbsp;a
line.<p>Second one; it goes on, and on &#8211; and ends here.<div class="advert">Buy!</div><ul><li>item one<li>item two</ul>
<script>if (1 < 2) { document.write("</p>"); }</script><blockquote>A quote, of some length, that is kept too.</blockquote><!-- <p>not</p> --></article>
<section class="comments"><p>Nice post, I liked it, really, so much, indeed!</p></section></div>
<aside><p>Other stories, many, many of them.</p></aside><form><p>Name, please: <input></p></form><footer>&copy; Us.</footer></body></html>"""
TEXT = ["Title & more", "First paragraph, with bold and a line.", "Second one; it goes on, and on – and ends here.", "item one", "item two",
        "A quote, of some length, that is kept too."]


def test_article_only():
    assert html.main_text(PAGE) == "\n\n".join(TEXT)
    bare = PAGE.replace("<article>", "<div>").replace("</article>", "</div>")
    assert html.main_text(bare) == "\n\n".join(TEXT)


@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("plain text &lt;3", "plain text <3"), ("<p>cut sho", "cut sho"), ("<p>cut <a hre", "cut"), ("<p>a &am", "a &am"), ("<script>x", ""),
    ("<div><p>a</div></div></p>b", "a\n\nb"), ("<p title='a > b'>q</p>", "q"), ("a < b", "a < b"), ("<p>x<br>y", "x y"), ("<nav>only menu</nav>", "")])
def test_broken_pages(page, text):
    assert html.main_text(page) == text


def test_pages_table(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    out = queries.op6_html_extraction(spark, sf).collect()
    assert len(out) == pages.count() and all(r.n_chars == len(r.text) for r in out)
    for r, p in zip(sorted(out), sorted(pages.collect()), strict=True):
        assert r.url == p.url and "<p>" not in r.text and (not p.html or r.text)
    extra = pages.limit(3).withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit(None))
    assert html.extract(extra).select("_row.*").columns == ["page_id", "url", "text", "n_chars"]
    assert html.extract(extra.limit(0)).count() == 0


@pytest.mark.parametrize("wrap", ['<div class="content has-sidebar">', '<div id="page" class="no-sidebar">', '<div class="widget">', '<div id="comments" class="sidebar">'])
@pytest.mark.parametrize("holder", ["article", "div"])
def test_names_of_wrappers_do_not_drop_the_page(wrap, holder):
    said = ["First words of it, long enough to count.", "And more of it, with a second sentence. It ends here."]
    page = f"<body><nav>menu</nav>{wrap}<{holder}>" + "".join(f"<p>{t}</p>" for t in said) + f"</{holder}></div><div class='site-footer'>Foot</div></body>"
    assert html.main_text(page) == "\n\n".join(said)


def test_names_inside_the_article():
    page = ("<article><h1>Title</h1><p>One sentence, and a bit more of it.</p><section id='related-work'><h2 id='search'>Search</h2><p id='notice-period'>The notice, as agreed, is a month.</p></section>"
            "<p class='search'>Kept, as a paragraph.</p><div class='related-posts'>Other posts</div><div class='ad'>Buy, now!</div><div class='comments'><p>Nice, thanks.</p></div></article>")
    assert html.main_text(page).split("\n\n") == ["Title", "One sentence, and a bit more of it.", "Search", "The notice, as agreed, is a month.", "Kept, as a paragraph."]


def test_text_beside_the_container_stays():
    long = "One long paragraph, with words in it, and more of them. It goes on, as such texts do."
    inner = f"<div><p>{long}</p><p>{long}</p></div>"
    pages = {
        f"<div><h1>Title</h1>{inner}<div>Closing paragraph.</div></div>": ["Title", long, long, "Closing paragraph."],
        f"<body><div><h2>Title</h2>{inner}</div><footer>Us.</footer></body>": ["Title", long, long],
        f"<body><div>{inner}</div><div><div><p>{long}</p></div></div><nav>Home</nav></body>": [long, long, long],
    }
    for page, text in pages.items():
        assert html.main_text(page).split("\n\n") == text


@pytest.mark.parametrize("page", ["<div>" * 40_000, "<font>x" * 28_000, "<div>x. " * 25_000, "<font><b>x</i></p>" * 11_000])
def test_deep_nesting_takes_little_memory(page):
    tracemalloc.start()
    try:
        text = html.main_text(page)
        assert tracemalloc.get_traced_memory()[1] < 100e6
    finally:
        tracemalloc.stop()
    assert text.count("x") == page.count("x")


def test_planted_boilerplate_goes_and_the_article_stays():
    g = np.random.default_rng(21)
    word = lambda: "".join(g.choice(list("abcdefghijkl"), int(g.integers(2, 9))))
    said = lambda n: " ".join(word() for _ in range(n)) + "."
    for k in range(60):
        paragraphs = [", ".join(said(int(g.integers(6, 15))) for _ in range(3)) for _ in range(int(g.integers(3, 9)))]
        title = said(5)
        links = "".join(f"<li><a href=/{word()}>{word()}</a></li>" for _ in range(int(g.integers(3, 20))))
        body = f"<h1>{title}</h1>" + "".join(f"<p>{p}</p>" for p in paragraphs)
        tag = ("article", "main", "div")[k % 3]
        around = [f"<nav><ul>{links}</ul></nav>", f"<div class=sidebar><ul>{links}</ul></div>", f"<div id=comments><p>{said(9)}</p></div>", f"<form>{said(4)}</form>",
                  f"<script>{said(9)}</script>", f"<footer>{said(6)}</footer>", f"<div class=ad-box>{said(7)}</div>", f"<aside><p>{said(12)}</p></aside>"]
        cut = int(g.integers(0, len(around)))
        page = f"<html><body>{''.join(around[:cut])}<{tag}>{body}</{tag}>{''.join(around[cut:])}</body></html>"
        assert html.main_text(page).split("\n\n") == [title, *paragraphs]


# --- archives ---------------------------------------------------------------------


def b32(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_archives_round_trip(spark):
    rows = [(5, "http://a/ü x\n", "same"), (3, None, "same"), (9, "u", "same"), (3, "u2", "same"), (4, "u", None), (1, "u", ""), (7, "u", "PK\x05\x06 other\r\n\r\n"),
            (None, "u", "same"), (8, "u", "y" * 100_000)]
    d = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, key string")
    packages = warc.write(warc.typed(d), warc.new_folder(spark), records=3)
    assert packages.count() >= 3 and packages.groupBy().sum("records").first()[0] == 9
    got = warc.read(warc.index(packages)).collect()
    low = {"same": 3, "": 1}
    want = []
    for p, _, t in rows:
        t = t or ""
        other = low.get(t) if p is not None and p > low.get(t, p) else None
        want.append((p or -1, "revisit" if other else "response", len(t.encode()), b32(t), other, None if other else t))
    assert sorted((r.page_id or -1, r.record_type, r.payload_bytes, r.payload_digest, r.refers_to, None if r.payload is None else bytes(r.payload).decode()) for r in got) == sorted(want, key=str) \
        or sorted(want, key=str) == sorted(((r.page_id or -1, r.record_type, r.payload_bytes, r.payload_digest, r.refers_to, None if r.payload is None else bytes(r.payload).decode()) for r in got), key=str)
    big = warc.typed(d, least=5).where("refers_to is not null").count()
    assert big == 0
    assert warc.read(warc.index(warc.write(warc.typed(d.limit(0)), warc.new_folder(spark)))).count() == 0


def test_pages_in_archives(spark, sf):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    low = {}
    for p in sorted(pages):
        low.setdefault(pages[p] or "", p)
    got = {r.page_id: r for r in queries.op7_warc(spark, sf).collect()}
    assert got.keys() == pages.keys()
    for p, t in pages.items():
        first = low[t or ""]
        assert tuple(got[p])[1:] == (len((t or "").encode()), b32(t), "response" if first == p else "revisit", None if first == p else first)


def test_zip64_directory():
    """A package whose end record points to a ZIP64 one, and wide fields."""
    name, body = b"archive/data.warc.gz", b"stored bytes"
    local = struct.pack("<4sHHHHHIIIHH", b"PK\x03\x04", 45, 0, 0, 0, 0, 0, len(body), len(body), len(name), 0) + name + body
    wide = struct.pack("<HHQQQ", 1, 24, len(body), len(body), 0)
    entry = struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\x01\x02", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(wide), 0, 0, 0, 0, 0xFFFFFFFF) + name + wide
    end64 = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, 1, 1, len(entry), len(local))
    raw = local + entry + end64 + struct.pack("<4sIQI", b"PK\x06\x07", 0, len(local) + len(entry), 1)
    raw += struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    at, n = warc.members(lambda o, k: raw[o : o + k], len(raw))[name.decode()]
    assert raw[at : at + n] == body
    plain = io.BytesIO()
    with zipfile.ZipFile(plain, "w") as z:
        z.writestr("a", b"1" * 10)
        z.writestr("b", b"22")
    raw = plain.getvalue()
    assert {k: raw[o : o + m] for k, (o, m) in warc.members(lambda o, k: raw[o : o + k], len(raw)).items()} == {"a": b"1" * 10, "b": b"22"}


# --- search -----------------------------------------------------------------------


def test_top_k_equals_brute_force(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(map(tuple, queries.op8_exact_top_k(spark, sf).collect())) == brute.top_k(rows)


def test_top_k_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(k, [0.5 * (k % 3), -0.25, 1.0 / (k + 1)]) for k in range(45)]
    rows += [(100, None), (120, [nan, 0.0, 0.0]), (140, [inf, 0.0, 0.0]), (160, [None, 1.0, 1.0]), (180, [1e200, -1e200, 3.0]), (181, [1.0, 1.0])]
    d = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, rank int")
    plain = [r for r in rows if r[0] < 100]
    assert sorted(map(tuple, search.top_k(d.where("vec_id < 180")).collect())) == brute.top_k(plain)
    assert search.top_k(d).where("query_id = 180").count() == 20
    assert search.top_k(d.where("vec_id < 4")).count() == 3
    assert search.top_k(d.limit(0)).count() == 0


# --- pipeline ---------------------------------------------------------------------


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    given, before = docs, docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.cut(stage(spark, given, sf))
        after = out.collect()
        if name != "mixing":
            assert out.columns == docs.columns
        if name == "toxicity":
            model = toxicity.fit(docs, labels, toxicity.not_held_out())
            bad = {r["doc_id"] for r in toxicity.score(docs, model, keep=["doc_id"]).where("score >= 0.3").select("_row.doc_id").collect()}
            assert {r.doc_id for r in after} == text.keys() - bad
        if name == "simhash_near_dedup":
            low = brute.near_components([(r.doc_id, brute.fingerprint(r.text)) for r in before])
            assert {r.doc_id for r in after} == set(low.values()) and len(after) == len(set(low.values()))
        if name == "benchmark_decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            bad = {d for d, v in brute.contamination([(r.doc_id, r.text) for r in before], items).items() if v[4]}
            assert {r.doc_id for r in after} == {r.doc_id for r in before} - bad
        if name == "pii":
            assert len(after) == len(before) and all(r.n_chars == len(r.text) for r in after)
            assert sum(r.text != text[r.doc_id] for r in after) > 0
        if name == "mixing":
            assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before)
        given, before = out, after


def test_pipeline_of_odd_rows(spark, odd_docs, tmp_path):
    docs = odd_docs.select("doc_id", "text", F.lit("en").alias("lang"), "source", F.col("n_words").alias("n_chars"))
    for part in (docs, docs.limit(0)):
        where = str(tmp_path / str(part.count()))
        part.write.parquet(f"{where}/documents.parquet")
        spark.createDataFrame([(4, 0, 1), (5, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
        spark.createDataFrame([(1, "some item"), (2, None)], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
        out = corpus_pipeline.run(spark, where)
        assert "taken" in out.columns and out.count() <= part.count()
