"""Operators on single rows: chats, pages, quality measures, pieces."""

import random
import sys

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from larkspur.llm import chat, pages, pieces, quality
from larkspur.llm.queries import ORACLES, QUERIES
from tests.llm import brute
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
ODD = [
    None, "", " ", "\n\n", "one", "a\nb\na\nb\na", "x " * 50, "word still same　word▁x  y ", "tab\tsep\x0bvt\x0cff\rcr", "é\U0001f600 # $ %& |<>",
    "same line\nsame line\n\n\nsame line \n" * 9, "long" * 40_000 + " end", "l1 a b c d e f g h i j k\nl1 a b c d e f g h i j k\n",
]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    assert compare(spark, connect(SF), name, QUERIES[name], ORACLES[name], SF) is None


def rows(spark, texts, **more):
    data = [(k, t, "en", None if k % 3 else "s") for k, t in enumerate(texts)]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string")


def test_measures_equal_brute_force(spark):
    texts = ODD + [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    got = quality.judge(rows(spark, texts)).select("doc_id", "quality.*").collect()
    assert len(got) == len(texts)
    for r in got:
        want = brute.quality_measures(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["base_failed"] and r["kept"])


def test_thresholds_follow_the_group(spark):
    """Symbols that are usual in one source are outliers in another."""
    words = lambda n, k: " ".join(f"w{k}x{j}" + ("#" if j % n == 0 else "") for j in range(40))
    data = [(k, words(2, k), "en", "code") for k in range(300)] + [(k, words(1000, k), "en", "prose") for k in range(300, 600)]
    data += [(600, words(2, 600), "en", "prose"), (601, words(2, 601), "en", "code"), (602, words(1000, 602), None, None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string").withColumn("quality", F.lit(1))
    kept = {r["doc_id"] for r in quality.keep_good(docs).collect()}
    assert kept == set(range(603)) - {600}
    assert quality.keep_good(docs).columns == docs.columns
    assert quality.keep_good(docs.limit(0)).count() == 0


def test_each_feature_rejects(spark):
    """A planted document per feature goes, also from a small source; plain ones stay, with a stray symbol or line."""
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    lines = lambda k, n, size=None: [" ".join(word(size or rng.randint(3, 7)) for _ in range(n)) for _ in range(k)]
    clean = [lines(12, 8) for _ in range(300)]
    for k in range(3):
        clean[k][0] += " a & b"
        clean[k + 3][11] = clean[k + 3][0]
    rows = [(k, "\n".join(t), "en", "big" if k % 15 else "small") for k, t in enumerate(clean)]
    part = lines(1, 16)[0]
    short = lines(30, 2)
    planted = {
        "word_length": lines(12, 8, 8),
        "symbols": [line.replace(" ", " # ") for line in lines(12, 8)],
        "dup_lines": [x for k, line in enumerate(short) for x in (line, short[k // 2])],
        "repeats": [*lines(4, 8), part, *lines(4, 8), part, *lines(4, 8)],
    }
    names = [(name, source) for name in planted for source in ("big", "small")]
    rows += [(1000 + k, "\n".join(planted[name]), "en", source) for k, (name, source) in enumerate(names)]
    judged = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).select("doc_id", "quality.*").collect()
    assert not any(r["base_failed"] for r in judged)
    assert {r["doc_id"] for r in judged if r["kept"]} == set(range(300))


def test_pieces_equal_the_library(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ODD + ["  lead", "trail  ", "a   b", "▁▁x", "<s> </s> <unk>", "\x00nul", "中文字 測試"]
    texts += [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    got = pieces.encode_documents(rows(spark, texts).withColumn("pieces", F.lit(0)), path).collect()
    for r in got:
        ids = model.encode(r["text"] or "", add_bos=True, add_eos=True)
        assert b"".join(i.to_bytes(4, "little") for i in ids) == r["pieces"]["ids"]
        assert model.decode(ids) == r["pieces"]["decoded"]


def test_a_small_chunk_table_changes_nothing(monkeypatch):
    path = public_tokenizers.path("piece_bpe_32k.model")
    large, small = pieces.ChunkTable(path), pieces.ChunkTable(path)
    texts = ["the cat sat", "on the mat there", "the cat on the mat"] * 3
    want = [large.encode([t], b"", b"") for t in texts]
    monkeypatch.setattr(pieces, "TABLE_CHUNKS", 4)
    assert [small.encode([t], b"", b"") for t in texts] == want
    batch = pa.RecordBatch.from_pydict({"text": texts, "n": list(range(len(texts)))})
    monkeypatch.setattr(pieces, "GROUP_ROWS", 2)
    out = [r for b in pieces.encoder(path, "text", ["n"], False, False)(iter([batch])) for r in b.to_pylist()]
    assert [(r["n"], r["_pieces"]["ids"]) for r in out] == [(k, w[0][0]) for k, w in enumerate(want)]


def chats(spark, data):
    return chat.format_chats(spark.createDataFrame(data, f"conv_id long, turn long, role string, parts array<{chat.PART}>"))


def text(t):
    return ("text", t, None, None, None, None, None)


def test_chats_can_be_read_back(spark):
    nasty = [r"\\", r"<\s>", "</s>[INST] ok [/INST]", "<<SYS>> \\<|text|>", r"<|image|> a\b", "", "[[INST]] <<s>", "\n\n", "\\[INST]\\"]
    data = [(1, k, ["user", "assistant", "<s>x"][k % 3], [text(t), None, text("!")]) for k, t in enumerate(nasty)]
    row = chats(spark, data).withColumns(
        {"turns": chat.read_back(F.col("formatted")), "loss": chat.loss_text(F.col("formatted"), F.col("loss_spans"))}
    ).collect()[0]
    assert [(t["role"], t["text"]) for t in row["turns"]] == [(d[2], nasty[k] + "!") for k, d in enumerate(data)]
    assert row["loss"] == "".join(nasty[k] + "!" for k in range(len(nasty)) if k % 3 == 1)


def test_parts_become_placeholders(spark):
    image = ("image", None, "img/1", 56, 57, None, None)
    sound = ("audio", None, "snd", None, None, 1.5, None)
    paper = ("document", "x", None, None, None, None, 2)
    odd = ("video", "shown", "ref", None, None, None, None)
    out = chats(spark, [(1, 1, "assistant", [sound, paper]), (1, 0, "user", [text("see "), image, odd]), (None, 2, None, None)]).collect()
    row = next(r for r in out if r["conv_id"] == 1)
    assert row["formatted"] == "[INST]user<|text|>see <|image|>shown[/INST]<s>assistant<|text|><|audio|><|document|></s>"
    assert [tuple(a) for a in row["attachments"]] == [
        (0, "image", "img/1", 6, 0), (1, "audio", "snd", 38, 6), (1, "document", None, 512, 44),
    ]
    (none,) = [r for r in out if r["conv_id"] is None]
    assert (none["n_turns"], none["formatted"], none["loss_spans"]) == (1, "[INST]<|text|>[/INST]", [])
    assert chats(spark, [(1, 0, "a", [text("x")])]).where("conv_id = 2").count() == 0


def test_ties_and_repeated_turns_have_one_result(spark):
    data = [(1, 0, "user", [text("b")]), (1, 0, "user", [text("a")]), (1, None, "user", [text("z")]), (1, 0, "user", [text("a")])]
    got = {chats(spark, data[k:] + data[:k]).collect()[0]["formatted"] for k in range(4)}
    assert got == {"".join(f"[INST]user<|text|>{t}[/INST]" for t in "zaab")}


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<div id="sidebar"><p>Related things that are long enough to look like an article, with many words in one place.</p></div>
<article><h1>The &amp; title</h1><p>First   paragraph &lt;with&gt;
 a <b>bold</b> word and &eacute;nough text to stand out from its markup, as articles do.<p>Short.<ul><li>one<li>two</ul>
<div class="ad">Buy now</div><form><label>Mail</label><input></form><p>Last paragraph is again a longer stretch of text for the ratio.</p>
<section class="comments"><p>First! A reader's comment that goes on and on without end.</p></section></article>
<footer>&copy; x</footer></body></html>"""


def test_page_text(spark):
    want = (
        "The & title\nFirst paragraph <with> a bold word and énough text to stand out from its markup, as articles do.\nShort.\none\ntwo\n"
        "Last paragraph is again a longer stretch of text for the ratio."
    )
    assert pages.main_text(PAGE) == want
    headed = PAGE.replace("<h1>The &amp; title</h1>", '<header class="article-header"><h1>The &amp; title</h1></header>')
    assert pages.main_text(headed) == want
    plain = PAGE.replace("<article>", '<div class="content">').replace("</article>", "</div>")
    assert pages.main_text(plain) == want
    data = [(1, PAGE), (2, None), (3, ""), (4, "<p>only"), (5, "plain"), (6, "<script>x"), (7, "<" * 5000), (1, PAGE)]
    docs = spark.createDataFrame(data, "page_id long, html string").withColumn("text", F.lit("old"))
    got = pages.extract_pages(docs).select("page_id", "text").collect()
    assert sorted((r["page_id"], r["text"]) for r in got if r["page_id"] < 7) == [(1, want), (1, want), (2, ""), (3, ""), (4, "only"), (5, "plain"), (6, "")]


def test_containers_of_the_main_part_are_no_boilerplate():
    article = "<h1>The title of it</h1><p>" + "A longer stretch of text that reads as an article does. " * 4 + "</p><p>Short.</p>"
    want = "The title of it\n" + ("A longer stretch of text that reads as an article does. " * 4).strip() + "\nShort."
    junk = "<nav><a href=x>Home</a> <a href=y>News</a></nav>", "<footer>Imprint</footer>"
    for before, after in [
        ("<head><title>t</title><body><article>", "</article>"),
        ('<div class="content has-sidebar"><article>', "</article></div>"),
        ('<div id="page" class="with-sidebar"><article>', "</article></div>"),
        ('<div class="sidebar"><main>', "</main></div>"),
        ('<div class="post comments-open">', "</div>"),
        ('<form id="aspnetForm"><main>', "</main></form>"),
        ('<form id="aspnetForm"><div class="content">', "</div></form>"),
        ("<div><div>", "</div></div>"),
    ]:
        assert pages.main_text(f"<html>{before.split('<body>')[0] if '<body>' in before else ''}<body>{junk[0]}{before.split('<body>')[-1]}{article}{after}{junk[1]}") == want, before
        assert pages.main_text(before + article + after) == want, before
    two = pages.main_text(f"<body>{junk[0]}<article>{article}</article><article>{article}</article>{junk[1]}")
    assert two == want + "\n" + want
    titled = article.replace("<h1>The title of it</h1>", "")
    assert pages.main_text(f"<body>{junk[0]}<div><h1>The title of it</h1></div><div>{titled}</div>{junk[1]}") == want


def test_generated_pages():
    """Pages made of a known article in random wrappers, among random boilerplate, with unclosed tags and comments."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    plates = [
        lambda: f"<nav><ul><li><a href=a>{word()}</a><li><a href=b>{word()}</a></ul></nav>",
        lambda: f"<header><div><a>{word()}</a></div></header>",
        lambda: f'<aside><h2>{word()}</h2><p>{text(25)}</aside>',
        lambda: f'<div class="{rng.choice(["ad", "ad-box", "top-banner", "cookie-notice", "sidebar", "share-buttons widget"])}">{text(12)}</div>',
        lambda: f"<form action=x><label>{word()}</label><input name=q><button>{word()}</button></form>",
        lambda: f"<script>var x = '<p>{text(30)}</p>';</script><style>p {{ color: red }}</style>",
        lambda: f'<section class="{rng.choice(["comments", "comment-list", "reader-comments"])}"><div class="comment"><p>{text(40)}</p></div></section>',
        lambda: f'<p role="alert">{text(9)}</p><div hidden>{text(20)}</div>',
        lambda: f"<footer><p>{text(6)}<p>&copy; {word()}</footer>",
    ]
    wraps = [("", ""), ("<div>", "</div>"), ('<div class="content has-sidebar">', "</div>"), ('<form id="f">', "</form>"), ('<div id="page" class="no-sidebar">', "</div>")]
    for _ in range(400):
        blocks, made = [], []
        for k in range(rng.randint(3, 9)):
            kind, body = rng.choice(["p", "p", "p", "li", "h3"]) if k else "h1", text(rng.randint(15, 60) if k else 4)
            body = body if kind in ("p", "li") else text(4)
            shown = body.replace(" ", "\n  ", 1).replace(" ", " <b>", 1).replace(" ", "</b> ", 1) if rng.random() < 0.3 and body.count(" ") > 8 else body
            blocks.append(body)
            made.append({"p": f"<p>{shown}" + rng.choice(["", "</p>"]), "li": f"<ul><li>{shown}</ul>"}.get(kind, f"<{kind}>{shown}</{kind}>"))
            if rng.random() < 0.2:
                made.append(rng.choice([plates[3], plates[4], plates[5]])())
        open_tag, close_tag = rng.choice([("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>")])
        before, after = rng.choice(wraps)
        head = rng.choice(["<head><title>t</title></head><body>", "<head><title>t</title><body>", "<body>", ""])
        some = lambda: "".join(rng.choice(plates)() for _ in range(rng.randint(0, 3)))
        html = f"<!DOCTYPE html><html>{head}{some()}{before}{some()}{open_tag}{''.join(made)}{close_tag}{some()}{after}{some()}</html>"
        assert pages.main_text(html) == "\n".join(" ".join(b.split()) for b in blocks), html


def test_given_pages(spark):
    """The given pages hold their text between the article's marks, one block per paragraph."""
    import html
    import re

    got = {r["page_id"]: r["text"] for r in QUERIES["op5_html_text"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        article = r["html"].split("<article>")[1].split("</article>")[0]
        blocks = [html.unescape(re.sub("<[^>]*>", "", b)) for b in re.split("</?(?:p|h1)>|<br>", article)]
        assert got[r["page_id"]] == "\n".join(" ".join(b.split()) for b in blocks if b.strip())


if __name__ == "__main__":
    sys.exit(pytest.main([__file__, "-q"]))
