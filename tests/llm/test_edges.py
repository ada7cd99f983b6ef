"""Every operator on the rows that break things: nulls, empty and very long texts, ties, repeats, clashing columns."""

from __future__ import annotations

import pytest
from citeweft.llm import ann, chat, langid, maxent, mixing, ngram_join, packing, quality, secret_scan, url_rules

LONG = "word " * 60_000 + "token = \"abcdef123456abcdef123456\" end"
NEAR = " ".join(f"w{i}" for i in range(60))

ROWS = [
    (0, None, "en", "a", 0),
    (1, "", "en", None, 0),
    (2, " \n\t ", None, "a", 4),
    (3, NEAR, "en", "a", 100),
    (4, NEAR + " x", "en", "b", 101),
    (5, NEAR.upper(), None, "b", 100),
    (6, LONG, "en", "a", len(LONG)),
    (None, "no id here at all", "de", None, 3),
    (7, "same text", "de", "c", 9),
    (7, "same text", "de", "c", 9),
    (8, "é\u3000ü\x0b\x1cz \U0001f600 <|im_end|>", "fr", "c", None),
    (9, "1234 5678", "fr", "c", 9),
]
DDL = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    """The rows with more columns, some of which repeat a name that operators use or differ in case only."""
    df = spark.createDataFrame(ROWS, DDL)
    wide = df.select("*", df.text.alias("TEXT"), df.doc_id.alias("size"), df.doc_id.alias("key"), df.lang.alias("node"), df.lang.alias("node"), df.doc_id.alias("n"))
    return wide


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DDL)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(3, 1, 0), (4, None, 0), (None, 0, 1), (6, 0, 0), (6, 1, 0)], "doc_id long, quality int, toxic int")


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def test_langid(docs, none):
    out = langid.identify(docs)
    got = rows(out, "doc_id", "lang_pred", "score")
    assert len(got) == len(ROWS)
    said = {d: (p, s) for d, p, s in got}
    assert said[0] == said[1] == said[2] == said[9] == ("und", 0.0)
    assert all(0 <= s <= 1 for _, _, s in got) and said[3][0] != "und"
    assert langid.identify(none).count() == 0


def test_langid_without_labels(spark):
    df = spark.createDataFrame([(1, "some words", None)], "doc_id long, text string, lang string")
    assert rows(langid.identify(df), "doc_id", "lang_pred", "score") == [(1, "und", 0.0)]


def test_ngram_join(docs, none):
    got = rows(ngram_join.near_duplicates(docs), "doc_id", "n_shingles", "component_id")
    assert len(got) == len(ROWS)
    said = {d: (n, c) for d, n, c in got}
    assert said[0] == (0, 0) and said[1] == (0, 1) and said[2] == (0, 2)
    assert said[3] == (56, 3) and said[4] == (57, 3) and said[5] == (56, 3)
    assert said[None] == (1, None) and said[7] == (1, 7) and got.count((7, 1, 7)) == 2
    assert ngram_join.near_duplicates(none).count() == 0
    kept = rows(ngram_join.one_of_each_group(docs), "doc_id")
    assert kept == sorted([(0,), (1,), (2,), (3,), (6,), (7,), (8,), (9,), (None,)], key=repr)


def test_quality(docs, none, labels):
    got = {r.doc_id: r for r in quality.judge(docs, labels).collect()}
    assert got[0].n_words == got[2].n_words == 0 and got[0].base_failed and not got[0].kept
    assert got[3].n_words == 60 and got[3].kept and not got[6].kept
    assert got[6].n_repeat_words == 60_000
    assert quality.judge(none, labels).count() == 0
    assert quality.kept_documents(docs, labels).columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_mixing(docs, none):
    got = rows(mixing.taken_by_document(docs, block=8), "doc_id", "size", "source_size", "target", "taken")
    assert len(got) == len(ROWS)
    assert all(t <= 2 * s for _, s, _, _, t in got)
    assert {x[0]: x[1] for x in got}[0] == 0
    assert mixing.taken_by_document(none).count() == 0
    assert mixing.mixed_documents(docs, block=8).columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_secret_scan(docs, none):
    got = {r.doc_id: r for r in secret_scan.scan(docs).collect()}
    assert got[6].n_assign == 1 and got[6].n_hex == 1 and got[6].spans.startswith("assign:300000:")
    assert got[0].spans == "" and got[1].n_assign == 0
    assert secret_scan.scan(none).count() == 0
    red = {r.doc_id: r.text for r in secret_scan.redacted_documents(docs).collect()}
    assert red[0] is None and "abcdef123456" not in red[6] and red[3] == NEAR


def test_maxent(docs, none):
    got = {r.doc_id: r for r in maxent.score(docs).collect()}
    assert got[0].n_tokens == 1 and got[3].n_tokens == 61 and len(got) == len(ROWS) - 1
    assert all(r.score <= 0 and r.base_score <= 0 for r in got.values())
    assert maxent.score(none).count() == 0


def test_packing(docs, none):
    out = packing.pack(docs).collect()
    sizes = {}
    for r in out:
        sizes[r.doc_id] = sizes.get(r.doc_id, 0) + r.length
    assert sizes[0] == sizes[1] == 1 and sizes[7] == 2 * next(r.doc_tokens for r in out if r.doc_id == 7)
    at = sorted((r.sequence_id * 1024 + r.offset, r.length) for r in out)
    assert at[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(at, at[1:], strict=False))
    assert packing.pack(none).count() == 0


def test_chat(spark):
    c = spark.createDataFrame([(1, 1, "user", None), (1, 0, None, "<|im_start|>"), (1, 1, "user", "x"), (1, 1, "user", "x"), (None, 0, "as\n\\sistant", "<\\|x"), (2, None, "assistant", LONG)], "conv_id long, turn long, role string, text string")
    pieces = chat.render(chat.fold_events(chat.conversation_events(c)))
    got = {r.conv_id: r for r in chat.digest(pieces).collect()}
    assert got[1].n_turns == 4 and got[2].loss_chars == len(LONG) and got[None].n_turns == 1
    back = sorted((r.conv_id is None, r.conv_id or 0, r.message_id, r.piece) for r in pieces.collect())
    parsed = [chat.PIECE.fullmatch(p).groups() for *_, p in back]
    assert [(chat.unescape_role(r), chat.unescape(t)) for r, t in parsed] == [("", "<|im_start|>"), ("user", ""), ("user", "x"), ("user", "x"), ("assistant", LONG), ("as\n\\sistant", "<\\|x")]
    assert chat.digest(chat.render(chat.fold_events(chat.conversation_events(c.limit(0))))).count() == 0


def test_ann(spark):
    rows_ = [(i, [float(i % 7), 1.0, float(i)]) for i in range(1, 45)]
    rows_ += [(60, None), (80, [0.0, 0.0, 0.0]), (100, [1.0, None, 2.0]), (120, [float("nan"), 1.0, 1.0]), (140, [1.0]), (None, [1.0, 1.0, 1.0]), (20, [6.0, 1.0, 20.0])]
    df = spark.createDataFrame(rows_, "vec_id long, embedding array<float>").selectExpr("*", "vec_id as list", "vec_id as score")
    got = ann.search(df, k=50).collect()
    good = [(i, v) for i, v in rows_ if i is not None and (1 <= i < 45)]
    for q, v in good:
        if q % 20 == 0:
            want = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in good if i != q)
            mine = [(r["rank"], -r.score, r.vec_id) for r in got if r.query_id == q and r.vec_id != q]
            assert {i for _, _, i in mine} <= {i for _, i in want}
    assert ann.search(df.limit(0)).count() == 0


def test_urls(spark):
    urls = [None, "", "no scheme", "HTTP://A.NET/x?y#z", "http://example.net/en/1", "http://sub.example.com/de/2", "http://x.org/fr/", "http://x.com/q", "http://net", "x://y://z/w", "http://x.com/q"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "url as host", "url as tokens")
    from citeweft.llm.queries import URL_RULES

    got = {r.page_id: r for r in url_rules.filter_urls(df, URL_RULES).collect()}
    assert [got[i].host for i in range(4)] == ["", "", "", "a.net"] and got[3].path == "/x"
    assert [got[i].rule for i in (3, 4, 5, 6, 7)] == ["net/", "example.net/en/", "example.com/de/", "org/fr/", None]
    assert [got[i].verdict for i in (3, 4, 5, 6)] == ["block", "allow", "block", "allow"] and got[9].host == "y:"
    assert url_rules.filter_urls(df.limit(0), URL_RULES).count() == 0
