"""Operators that work on one text at a time, or on all texts in order."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lodestrata.llm import html_text, language, piece_bpe, token_files
from lodestrata.llm.common import work_path


def documents(spark, tables):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{tables}/documents.parquet").collect()}


# SentencePiece


@pytest.fixture(scope="module")
def pieces():
    return piece_bpe.encoder(public_tokenizers.path(piece_bpe.MODEL))


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80) | st.text("aeinrst ▁\n\t.,01é日 ", max_size=120))
def test_pieces_are_the_library_s(text):
    e = piece_bpe.encoder(public_tokenizers.path(piece_bpe.MODEL))
    assert e.encode(text) == e.library.encode(text)
    assert e.decode(e.encode(text)) == e.library.decode(e.library.encode(text))


def test_pieces_of_long_words(pieces):
    for text in ("a" * 5000, "ab" * 3000, " " * 500, "\n" * 300, "thethe" * 2000, "é" * 700, "\u0000" * 50):
        assert pieces.encode(text) == pieces.library.encode(text)


def test_op7(spark, tables):
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(piece_bpe.MODEL))
    docs = documents(spark, tables)
    got = piece_bpe.op7_sentencepiece(spark, tables).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = sp.encode(docs[r["doc_id"]]["text"])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest())


def test_op7_odd_rows(odd_documents, pieces):
    got = piece_bpe.encoded(odd_documents).collect()
    assert len(got) == 11
    for r in got:
        want = pieces.library.encode(r["rec"]["text"] or "")
        assert r["ids"] == want and r["decoded"] == (pieces.library.decode(want) if want else "")


# Token files


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80) | st.text("aAeß.,'st <|>0É́ \n", max_size=100))
def test_runs_give_the_library_s_ids(text):
    words = token_files._words(public_tokenizers.path(token_files.VOCABULARY))
    assert words.ids_of([text.encode("utf-8", "ignore")])[0].tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids + [token_files.END]


def test_runs_and_special_strings():
    words = token_files._words(public_tokenizers.path(token_files.VOCABULARY))
    for text in ("<|startoftext|> a<|endoftext|>b", "<|STARTOFTEXT|>", "J̌ ǰ", "Á. b", "I'm don't THEY'RE", "a.. b., c., d.", "x" * 3000, "﻿a 　 b"):
        assert words.ids_of([text.encode()])[0].tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids + [token_files.END]


def check_op8(rows, got):
    tok = Tokenizer.from_file(public_tokenizers.path(token_files.VOCABULARY))
    at = 0
    got = sorted(got, key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [i for i, _ in rows]
    for (_, text), r in zip(rows, got, strict=True):
        assert r["start"] == at
        at += r["n_tokens"]
    want = sorted((i is None, i or 0, len(ids := tok.encode(t or "", add_special_tokens=False).ids + [1]), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, t in rows)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["ids_crc32"]) for r in got) == want


def test_op8(spark, tables):
    rows = sorted((i, r["text"]) for i, r in documents(spark, tables).items())
    check_op8(rows, token_files.op8_token_files(spark, tables).collect())


def test_op8_odd_rows(spark, odd_documents):
    folder = work_path(spark, "t")
    rows = sorted(((r["doc_id"], r["text"]) for r in odd_documents.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    for files in (1, 3):
        where = f"{folder}-{files}"
        listed = token_files.write_token_files(odd_documents, where, files=files, length=64)
        check_op8(rows, token_files.read_documents(listed, where, pa.int64()).select(F.col("doc").alias("doc_id"), "start", F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32")).collect())
    empty = token_files.write_token_files(odd_documents.where("false"), f"{folder}-e")
    assert token_files.read_documents(empty, f"{folder}-e", pa.int64()).count() == 0


def test_sequences_are_views_of_equal_length(spark, tables):
    folder = work_path(spark, "t")
    parts = token_files.write_token_files(spark.read.parquet(f"{tables}/documents.parquet"), folder, files=2, length=128).collect()
    fs, _ = pyarrow.fs.FileSystem.from_uri(folder)
    for p in parts:
        f = token_files.TokenFile(fs, p["name"])
        n = -(-p["ids"] // 128)
        seqs = [f.sequence(i) for i in range(n)]
        assert all(len(s) == 128 and not s.flags.owndata for s, _ in seqs)
        assert all(m.to_pylist() == [True] * 128 for _, m in seqs[:-1]) and sum(seqs[-1][1].to_pylist()) == p["ids"] - 128 * (n - 1)
        assert np.concatenate([s for s, _ in seqs])[: p["ids"]].tolist() == np.concatenate(list(f.ids(0, p["ids"]))).tolist()


# HTML


def test_op9_takes_the_article(spark, tables):
    import html
    import re

    pages = {r["page_id"]: r for r in spark.read.parquet(f"{tables}/pages.parquet").collect()}
    got = html_text.op9_html_extraction(spark, tables).collect()
    assert len(got) == len(pages)
    for r in got:
        inside = re.search(r"<article>(.*?)</article>", pages[r["page_id"]]["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?p>|<br>|</?h1>", inside)]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


LONG = "These are the words of a paragraph that goes on for a while, as paragraphs do. " * 4


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<html><body></body></html>", ""),
        ("plain", "plain"),
        (f"<nav><a>x</a></nav><div id=main><p>Short.</p><p>{LONG}</p><p>{LONG}</p><p>End.</p></div><div class='sidebar'><p>{LONG}</p></div>", f"Short.\n{LONG.strip()}\n{LONG.strip()}\nEnd."),
        (f"<article><header>h</header><p>{LONG}<div class=comments><p>{LONG}</div><form>f</form><p>b&amp;amp; &nbsp;c&#x41;</article><p>out", f"{LONG.strip()}\nb&amp; cA"),
        (f"<main><script>if (a < b) '</p>'</script><style>p{{}}</style><p>a <b>b</b>c\n d<!-- <p>no</p> --><br>{LONG}</main><footer>no</footer>", f"a bc d\n{LONG.strip()}"),
        ("<article><p>one<p>two", "one\ntwo"),
        ("a < b & c", "a < b & c"),
    ],
)
def test_pages(page, text):
    assert html_text.main_text(page) == text


def test_core_is_the_longest_stretch():
    sizes = np.array([5, 4, 6, 5, 300, 280, 10, 350, 290, 4, 5, 3])
    assert html_text.core(sizes) == (4, 8)


def test_all_stretches_are_joined():
    parts = ["<p>" + "a" * 900 + "</p>", "".join(f"<p>{c}</p>" for c in "bcde"), "<p>" + "f" * 800 + "</p>"]
    want = "\n".join(["a" * 900, *"bcde", "f" * 800])
    for open_, close in (("<div class=part>", "</div>"), ("<blockquote>", "</blockquote>"), ("<ul><li>", "</li></ul>"), ("<table><tr><td>", "</td></tr></table>"), ("<section>", "</section>"), ("<pre>", "</pre>")):
        assert html_text.main_text("<div class=top><p>Home</p></div><div class=post>" + "".join(open_ + x + close for x in parts) + "</div>") == want
        assert html_text.main_text(f"<p>Home</p><div class=post>{open_}{parts[0]}{close}{parts[1]}{parts[2]}</div>") == want
    assert html_text.main_text("<p>Home</p><div>" + "".join(f"<article>{x}</article>" for x in parts) + "</div>") == want


@pytest.mark.parametrize(
    "page",
    [
        "<div class='layout has-sidebar'><p>{0}</p></div>",
        "<article class='post no-comments'><p>{0}</p></article>",
        "<main class=with-banner><p>{0}</p></main>",
        "<div id=social-policy><p>{0}</p></div>",
        "<div class=sidebar><article><p>{0}</p></article></div>",
        "<div class=widget><p>{0}</p></div><div class=comments><p>no</p></div>",
        "<body><form id=aspnetForm><div><p>{0}</p></div></form></body>",
        *(f"<div><{x} a=b>no</div><p>{{0}}</p>" for x in ("svg", "object", "audio", "video", "canvas", "select")),
        "<body><video src=x><p>{0}</p></body>",
        "<p>{0}</p><div class='cookie-banner'><p>no</p></div><div class=comment-list>no</div><svg><title>no</title></svg>",
    ],
)
def test_noise_is_what_a_box_is_named(page):
    assert html_text.main_text(page.format(LONG)) == LONG.strip()


def test_op9_odd_rows(spark):
    rows = [(1, None, None), (None, "u", "<p>x"), (2, "u", ""), (3, "u", "<p>" + "y " * 200_000), (3, "u", "<div" * 2000)]
    got = html_text.extracted(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("main_text", F.lit(1))).collect()
    assert sorted(len(r[1]) for r in got)[-1] == 399_999 and len(got) == 5


# Language


def test_op10_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = language.op10_language_id(spark, sf).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got) and len(got) == len(lang)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def slow_ngrams(text):
    import re
    from collections import Counter

    s = "_" + re.sub(r"[\W\d_]+", "_", (text or "").lower()).strip("_") + "_"
    return Counter(g for n in (1, 2, 3) for i in range(len(s) - n + 1) if (g := s[i : i + n]) and not (n == 1 and g == "_") and not (n == 2 and g == "__") and not (n == 3 and g[1] == "_")) if len(s) > 2 else Counter()


@pytest.mark.parametrize("text", [None, "", "123", "a", "Ab c", "Zürich, das ist 1 Test_text", "word " * 120_000 + "end", "x" * 600_000])
def test_ngrams(text):
    keys, counts = language.ngrams(text)
    name = {}
    for k in keys.tolist():
        parts = []
        while k:
            parts.append(chr(k & 0x1FFFFF))
            k >>= 21
        name[len(name)] = "".join(reversed(parts))
    want = slow_ngrams(text)
    assert {name[i]: int(c) for i, c in enumerate(counts)} == want


def test_distance_by_hand():
    model = language.Profiles([("aa", 1, 0), ("aa", 2, 1), ("bb", 2, 0)], ranks=3)
    model.grams  # noqa: B018
    assert model.langs == ["aa", "bb"] and model.rank.tolist() == [[0, 1], [3, 0]]


def test_op10_odd_rows(odd_documents):
    model = language.train(odd_documents)
    got = {(r["rec"]["doc_id"], r["rec"]["text"]): r for r in language.predicted(odd_documents, model).collect()}
    for r in got.values():
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["rec"]["text"] or "")) and 0 <= r["score"] <= 1
    nothing = language.train(odd_documents.where("false"))
    assert {r["lang_pred"] for r in language.predicted(odd_documents, nothing).collect()} == {"und"}


def test_only_texts_go_to_python(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    out = corpus_pipeline.language_id(spark, docs, tables)
    rows, nodes = out.collect(), [out._jdf.queryExecution().executedPlan()]
    assert sorted(rows, key=lambda r: r["doc_id"]) == sorted(docs.collect(), key=lambda r: r["doc_id"])
    for node in nodes:
        nodes += [node.children().apply(i) for i in range(node.children().size())]
    moved = [[node.metrics().apply(m).value() for m in ("pythonDataSent", "pythonDataReceived")] for node in nodes if node.metrics().contains("pythonDataSent")]
    assert len(moved) == 1 and size <= moved[0][0] < 1.2 * size and moved[0][1] < 0.2 * size
