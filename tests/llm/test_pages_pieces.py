"""Template deduction on built pages and the table's pages; piece coding against the library and round trips."""

import html
import re
from collections import Counter

import numpy as np
import pytest
import sentencepiece

from tenura.llm import pieces, template

PAGES = "page_id long, url string, html string, text string, host string"


def page(i, body, tag="div", menu=("Home", "News")):
    items = "".join(f"<li><a href='/{m}'>{m}</a></li>" for m in menu)
    return (
        f"<html><head><title>T {i}</title><style>p{{}}</style></head><body><div class='top'><h3>The Daily</h3></div>"
        f"<nav><ul>{items}</ul></nav><{tag}>{body}</{tag}><div class='side-bar'>Links {i}</div>"
        f"<footer>&copy; {i}</footer></body></html>"
    )


def test_tokens_and_keys():
    parts = template.tokens("<P Class=\"b a\" id=x9>Hi &amp; <!-- <p> --><script>var a='</p><b>'</script>5 < 6<br/></p")
    assert [k for k, *_ in parts] == ["open", "text", "skip", "skip", "text", "text", "text", "open", "close"]
    assert template.token_keys(parts)[0] == "<p.a b x"
    assert template.token_keys([("text", "", " a \n b ")]) == ["#a b"]


def test_extract_keeps_the_article_and_nothing_else():
    body = (
        "<article><header><h1>Title</h1></header><p>One&nbsp;<b>bo</b>ld &lt;x&gt;<br>two\n three<p>Four"
        "<aside>no</aside><form><input>no</form><div class='ad box'>no<div>no</div></div><ul><li>Five</li></ul>"
        "<noscript>no</noscript><section id='comments'><p>no</p></section></article>"
    )
    text = template.extract(page(1, body))
    assert text == "Title One bold <x> two three Four Five"
    assert template.extract("<p>plain <i>text</i></p>tail") == "plain text tail"
    assert template.extract("<div class=ad>open <article>kept</article>") == "kept"
    assert template.extract(None) == template.extract("") == template.extract("<") .replace("<", "") == ""
    assert template.extract("<article>a<b") == "a"
    assert len(template.extract("<article>" + "word " * 200_000 + "</article>")) == 999_999


def test_template_words_go_where_no_article_is_marked(spark):
    rows = []
    for i in range(12):
        body = f"<p>Own text {i}.</p>" * (1 + i % 3) + f"<p>More of {i}.</p>"
        rows.append((i, f"http://Site.example/{i}", page(i, body), "x", "y"))
    rows += [(50, None, None, "x", "y"), (51, "no url", "", "x", "y"), (None, "http://other.example/", "<p>Alone</p>", "x", "y")]
    rows += [(52, "http://site.example/52", "<p>Another <b>shape", "x", "y"), rows[0]]
    found = template.main_text(spark.createDataFrame(rows, PAGES).repartition(3)).collect()
    by = {r.page_id: r for r in found}
    assert len(found) == len(rows)
    for i in range(12):
        expected = " ".join([f"Own text {i}."] * (1 + i % 3) + [f"More of {i}.", f"Links {i}"])
        assert by[i].text == expected  # "The Daily" stands on every page and is the template's
    assert by[50].text == by[51].text == "" and by[None].text == "Alone" and by[52].text == "Another shape"
    assert all(r.n_chars == len(r.text) for r in found)
    assert template.main_text(spark.createDataFrame([], PAGES)).collect() == []


def test_the_template_decides_where_no_article_is_marked(spark):
    rows = []
    for i in range(8):
        body = f"<h2>Title {i}</h2>" + f"<div><p>Own sentence {i} of some length, and more of it.</p></div>" * (3 + i % 3)
        cards = f"<article>Card {i}</article>" * (1 + i % 2)  # teasers are articles, the text is not
        text = (
            f"<html><body><div class='wrap'><div class='ticker'>Tick {i}</div><div class='txt'><b>Share this</b>{body}"
            f"<i>Read on</i></div><div class='cards'>{cards}</div></div><p>Imprint</p></body></html>"
        )
        rows.append((i, f"http://plain.example/{i}", text, "x", "y"))
    pages = spark.createDataFrame(rows, PAGES)
    by = {r.page_id: r.text for r in template.main_text(pages).collect()}
    for i in range(8):
        assert by[i] == " ".join([f"Title {i}"] + [f"Own sentence {i} of some length, and more of it."] * (3 + i % 3))


def test_template_words_go_inside_the_article_too(spark):
    rows = []
    for i in range(8):
        text = (
            f"<html><body><article><h1>Head {i}</h1><p>{'Words of page %d. ' % i * (1 + i % 3)}</p><div><b>Share this</b></div>"
            f"</article><article class='comment'>Reply {i}</article></body></html>"
        )
        rows.append((i, f"http://marked.example/{i}", text, "x", "y"))
    by = {r.page_id: r.text for r in template.main_text(spark.createDataFrame(rows, PAGES)).collect()}
    for i in range(8):
        assert by[i] == f"Head {i} " + " ".join([f"Words of page {i}."] * (1 + i % 3))
    assert template.extract("<article class=comment>no</article><article>yes</article>") == "yes"


SENTENCES = [f"Sentence number {k} of the article tells something that no other one does." for k in range(8)]


def article(i, sentences=SENTENCES, heading="The same heading", tag="article"):
    text = "".join(f"<p>{s}</p>" for s in sentences)
    return f"<html><body><nav><a>Home</a></nav><{tag} class='story'><h1>{heading}</h1>{text}</{tag}><footer>Imprint</footer></body></html>"


def texts_of(spark, pages):
    rows = [(i, f"http://mirror.example/{i}", p, "x", "y") for i, p in enumerate(pages)]
    return [r.text for r in sorted(template.main_text(spark.createDataFrame(rows, PAGES)).collect(), key=lambda r: r.page_id)]


@pytest.mark.parametrize("tag", ["article", "div"])
def test_equal_pages_keep_their_article(spark, tag):
    want = " ".join(["The same heading", *SENTENCES])
    assert texts_of(spark, [article(0, tag=tag)] * 6) == [want] * 6


def test_a_row_repeated_five_times_keeps_its_article(spark):
    row = (1, "http://mirror.example/1", article(1), "x", "y")
    found = template.main_text(spark.createDataFrame([row] * 5, PAGES)).collect()
    assert [r.text for r in found] == [" ".join(["The same heading", *SENTENCES])] * 5


def test_mirrors_on_a_host_keep_their_article(spark):
    other = [[f"Page {i} says this in its sentence {k}, as none else." for k in range(6)] for i in range(4)]
    pages = [article(0)] * 6 + [article(i, other[i], f"Heading {i}") for i in range(4)]
    want = [" ".join(["The same heading", *SENTENCES])] * 6 + [" ".join([f"Heading {i}", *other[i]]) for i in range(4)]
    assert texts_of(spark, pages) == want


@pytest.mark.parametrize("tag", ["article", "div"])
def test_pages_that_differ_in_the_heading_alone_keep_their_article(spark, tag):
    pages = [article(i, heading=f"Heading {i}", tag=tag) for i in range(6)]
    assert texts_of(spark, pages) == [" ".join([f"Heading {i}", *SENTENCES]) for i in range(6)]


def test_near_copies_with_a_changed_sentence_keep_all_others(spark):
    changed = [SENTENCES[:3] + [f"On page {i} alone this sentence was changed."] + SENTENCES[4:] for i in range(7)]
    assert texts_of(spark, [article(i, changed[i]) for i in range(7)]) == [" ".join(["The same heading", *c]) for c in changed]


def test_quoted_values_may_hold_the_end_of_a_tag():
    assert template.extract("""<article><a title="a > b" href='x>y'>link</a> <b title="open>text</b></article>""") == "link text"
    assert template.extract("<script x='>'>no</script><p don't>yes</p>") == "yes"
    template.tokens("<p " + '="' * 100_000)


def test_very_long_pages(spark):
    words = "word " * 300_000
    assert [len(t) for t in texts_of(spark, [f"<article><p>{words}</p></article>"] * 5)] == [1_499_999] * 5


def test_classes_match_a_plain_grouping(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    vectors: dict[str, dict[str, Counter]] = {}
    for r in pages.collect():
        host = (re.match(r"[a-z]+://([^/?#:]+)", r.url, re.I) or ["", ""])[1].lower()
        keys = Counter(k for k in template.token_keys(template.tokens(r.html)) if k)
        vectors.setdefault(host, {})[(r.page_id, r.url)] = keys
    found = {r.host: r for r in template.templates(pages).collect()}
    for host, own in vectors.items():
        if len(own) < template.LEAST_PAGES:
            assert host not in found
            continue
        names = {k for c in own.values() for k in c}
        groups: dict[tuple, set[str]] = {}
        for k in names:
            vector = tuple(c.get(k, 0) for c in own.values())
            pages_with = sum(map(bool, vector))
            if pages_with >= template.LEAST_PAGES and pages_with >= template.SUPPORT * len(own):
                groups.setdefault(vector, set()).add(k)
        groups = {v: g for v, g in groups.items() if len(g) >= template.LEAST_TOKENS}
        once = [(sum(v), len(g), g) for v, g in groups.items() if max(v) == 1]
        if once:
            best = max(once, key=lambda x: x[:2])[2]
            assert set(found[host].frame) == {k for k in best if k[0] != "#"}


def plain_article(text):
    inner = re.search(r"(?s)<article>(.*?)</article>", text)[1]
    inner = re.sub(r"(?s)<(script|style).*?</\1>|<!--.*?-->", "", inner)
    parts = re.split(r"</?(?:p|h1|div|ul|li|br)[^>]*>", inner)
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in parts]
    return " ".join(b for b in blocks if b)


def test_pages_of_the_table(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    truth = {r.page_id: plain_article(r.html) for r in pages.collect()}
    found = {r.page_id: r.text for r in template.main_text(pages).collect()}
    assert found == truth


@pytest.fixture(scope="module")
def coders():
    return pieces.PieceCoder(pieces.model_path()), sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())


TEXTS = ["Hello world", "  two  spaces   ", "\n\nlines\n", "naïve café 中文 \U0001f600", "x" * 300, "a\tb\x00c", " ", "é" * 99 + " end."]


def test_without_dropout_it_is_the_library(coders, spark, folder):
    own, library = coders
    texts = TEXTS + [r.text for r in spark.read.parquet(f"{folder}/documents.parquet").limit(60).collect()]
    for text in texts:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text), text[:50]
        assert own.decode(np.frombuffer(own.encode(text), "<u4")) == text


def test_dropout_is_seeded_varied_and_lossless(coders):
    own, _ = coders
    text = "Segmentation regularises subword models considerably. " * 3 + "▁ literal"
    results = {own.encode(text, key, 0.2) for key in range(30)}
    assert len(results) > 20
    assert all(own.decode(np.frombuffer(x, "<u4")) == text for x in results)
    assert own.encode(text, 5, 0.2) == pieces.PieceCoder(pieces.model_path()).encode(text, 5, 0.2)
    plain, none = own.encode(text, 0, 0.0), own.encode(text, 0, 1.0)
    rate = np.mean([len(x) for x in results])
    assert len(plain) < rate < len(none)
    for symbol in np.frombuffer(none, "<u4").tolist():  # nothing was merged
        assert len(own.names[symbol]) == 1 or symbol in own.bytes_.values()


def test_every_merge_is_one_of_the_model(coders):
    """With dropout every piece still comes from merges of two pieces, down to characters."""
    own, _ = coders
    for key in range(20):
        for i in np.frombuffer(own.encode("unbelievable considerations everywhere", key, 0.3), "<u4").tolist():
            assert i in own.bytes_.values() or own.names[i] in own.pieces


def test_documents_round_trip(spark):
    rows = [(i, t, "en") for i, t in enumerate(TEXTS)] + [(90, None, "en"), (91, "", "en"), (None, "no key", "en"), (0, TEXTS[0], "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    coded = pieces.encode_documents(docs, dropout=0.3)
    back = coded.select("doc_id", "ids", pieces.decode_column("ids").alias("back")).collect()
    assert sorted((str(r.doc_id), r.back) for r in back) == sorted((str(k), t or "") for k, t, _ in rows)
    found = pieces.digests(docs, dropout=0.3).collect()
    assert all(r.lossless for r in found) and len(found) == len(rows)
    assert {r.doc_id: r.n_pieces for r in found} == {r.doc_id: len(r.ids) for r in back}
    assert pieces.digests(docs.limit(0)).collect() == []


def test_every_occurrence_of_a_word_draws_its_own_skips(coders, spark):
    own, _ = coders
    text = "considerably " * 400
    ids = np.frombuffer(own.encode(text, 7, 0.2), "<u4").tolist()
    words, word = Counter(), []
    for i in ids:
        if own.names[i].startswith(pieces.SPACE) and word:
            words[tuple(word)] += 1
            word = []
        word.append(i)
    assert len(words) > 10  # one document, one word, many segmentations
    docs = spark.createDataFrame([(i, "considerably so", "en") for i in range(200)], "doc_id long, text string, lang string")
    coded = pieces.encode_documents(docs, dropout=0.2).collect()
    assert len({tuple(r.ids) for r in coded}) > 10  # and over documents too
    assert coded == pieces.encode_documents(docs, dropout=0.2).collect()


@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.5, 1.0])
def test_kept_choices_give_what_each_chunk_gives_alone(coders, monkeypatch, dropout):
    own = pieces.PieceCoder(pieces.model_path())
    texts = [t for t in TEXTS * 8 if t] + ["Every occurrence of every word, extraordinarily considerable. " * 40]
    keys = pieces.document_keys(3, list(range(len(texts))))
    for limit in (pieces.CACHE_NODES, 10):  # the second empties the trees before every slice
        monkeypatch.setattr(pieces, "CACHE_NODES", limit)
        for text, key, found in zip(texts, keys, own.texts(texts, keys, dropout)):
            chunks = pieces.CHUNKS.findall(" " + text)
            salts = pieces.chunk_salts(np.full(len(chunks), key, np.uint64), np.arange(len(chunks)))
            alone = [i for c, s in zip(chunks, salts.tolist()) for i in own.segment(c, s, dropout)]
            assert np.frombuffer(found, "<u4").tolist() == alone


def test_candidates_are_skipped_at_the_rate_of_the_dropout():
    salts = pieces.chunk_salts(np.arange(100_000, dtype=np.uint64), np.zeros(100_000, np.int64))
    found = pieces.gaps(salts, 0, pieces.gap_limits(0.1))
    for k in range(5):
        assert abs((found == k).mean() - 0.1 * 0.9**k) < 0.004
