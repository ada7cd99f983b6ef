"""Provider payloads, files, exports, drift, and the registry's own consistency."""

from __future__ import annotations

from xml.etree import ElementTree

import json

import pytest
from citeweft.functions import scalars as S
from citeweft.functions.udfs import canonical
from citeweft.operators import verify
from citeweft.sinks import exports
from citeweft.sources import files, landed
from citeweft.streaming import labels as L
from pyspark.sql import functions as F


def bodies(spark, *items):
    return spark.createDataFrame([(json.dumps(x) if isinstance(x, dict) else x,) for x in items], "body string")


def test_openalex(spark):
    w = {
        "id": "https://openalex.org/W7", "doi": "https://doi.org/10.1000/Ab", "title": "On things", "publication_year": 2019, "type": "article", "language": "en", "is_retracted": False,
        "authorships": [{"author": {"display_name": "Ana Maria Silva", "orcid": None}}, {"author": {"display_name": "Li"}}],
        "primary_location": {"source": {"display_name": "J. Things"}}, "ids": {"pmid": "https://pubmed.ncbi.nlm.nih.gov/55"},
        "referenced_works": ["https://openalex.org/W1"], "cited_by_count": 3, "abstract_inverted_index": {"things": [1], "all": [0]},
    }
    r = landed.openalex(bodies(spark, w, {"error": "x"}, "no json")).collect()
    assert len(r) == 1
    r = r[0]
    assert (r.key, r.doi, r.year, r.venue, r.abstract, r.reference_count, r.cited_by_count) == ("doi:10.1000/ab", "10.1000/ab", 2019, "J. Things", "all things", 1, 3)
    assert [(a.surname, a.given) for a in r.authors] == [("Silva", "Ana Maria"), ("Li", None)] and r.source_ids == {"openalex": "W7", "pmid": "55"}


def test_crossref(spark):
    item = {
        "message": {
            "DOI": "10.1000/Q", "title": ["Main"], "container-title": ["Jour"], "type": "journal-article", "author": [{"family": "Cook", "given": "A"}, {"name": "A group"}],
            "issued": {"date-parts": [[2015, 2]]}, "published-online": {"date-parts": [[2014]]}, "references-count": 4,
            "reference": [{"key": "1", "DOI": "10.1000/R"}, {"key": "2", "article-title": "A title", "year": "1999a"}, {"key": "3", "unstructured": "Loose text 2001"}, {"key": "4"}],
        }
    }
    r = landed.crossref(bodies(spark, item, {"message": {"type": "x"}})).collect()
    assert [(x.key, x.title, x.year, len(x.authors)) for x in r] == [("doi:10.1000/q", "Main", 2014, 1)]
    refs = sorted((x.doi or "", x.title, x.unresolved, x.year) for x in landed.crossref_references(bodies(spark, item)).collect())
    assert refs == [("", "A title", True, 1999), ("", "Loose text 2001", True, None), ("10.1000/r", "", False, None)]


def test_semantic_scholar(spark):
    p = {"paperId": "abc", "externalIds": {"DOI": "10.1000/Z", "PubMed": "12"}, "title": "T", "year": 2000, "authors": [{"name": "B. Cook"}], "publicationTypes": ["JournalArticle"], "venue": "", "citationCount": 2}
    r = landed.semantic_scholar(bodies(spark, p, {"error": 1})).collect()[0]
    assert (r.key, r.type, r.venue, r.source_ids) == ("doi:10.1000/z", "journalarticle", None, {"pmid": "12", "s2": "abc"})


def test_semantic_scholar_pages(spark):
    refs = {"offset": 0, "next": 2, "data": [{"citedPaper": {"paperId": "abc", "externalIds": {"DOI": "10.1000/Z"}, "title": "T", "year": 2000}}, {"citedPaper": {"paperId": None, "title": None}}]}
    more = {"offset": 2, "data": [{"citedPaper": {"paperId": "abc", "externalIds": {"DOI": "10.1000/Z"}, "title": "T", "year": 2000}}]}
    cits = {"data": [{"citingPaper": {"paperId": "def", "title": "U", "authors": [{"name": "B. Cook"}]}}]}
    rows = [("w", json.dumps(refs)), ("w", json.dumps(more)), ("w", json.dumps(cits)), ("w", None), ("v", "{}"), ("v", "broken")]
    works, edges = landed.semantic_scholar_pages(spark.createDataFrame(rows, "key string, body string"))
    assert sorted((r.key, r.title) for r in works.collect()) == [("doi:10.1000/z", "T"), ("s2:def", "U")]
    assert sorted(tuple(r) for r in edges.collect()) == [("w", "doi:10.1000/z", "backward", "semanticscholar"), ("w", "s2:def", "forward", "semanticscholar")]
    assert set(works.columns) == set(landed.semantic_scholar(bodies(spark, {"paperId": "a"})).columns)


def test_seeds_go_to_the_first_provider_that_knows_them(spark):
    names = spark.createDataFrame([("10.1000/x", "k2", "second"), ("10.1000/x", "k1", "first"), ("s2:abc", "k3", "second"), ("10.1000/y", "k5", "zz"), ("10.1000/y", "k4", "aa")], "ident string, key string, provider string")
    idents = spark.createDataFrame([("https://doi.org/10.1000/X",), ("abc",), ("doi:10.1000/y",), ("none",), ("abc",), (None,)], "ident string")
    got = {r.ident: (r.key, r.provider) for r in files.resolve_seeds(idents, names, ["first", "second"]).collect()}
    assert got == {"https://doi.org/10.1000/X": ("k1", "first"), "abc": ("k3", "second"), "doi:10.1000/y": ("k4", "aa"), "none": (None, None), None: (None, None)}
    assert files.resolve_seeds(idents, names.limit(0), []).where("key is not null").count() == 0


TEI = """<TEI><text><listBibl>
<biblStruct xml:id="b0"><analytic><title level="a">First paper</title><author><persName><surname>Cook</surname></persName></author><idno type="DOI">10.1000/F</idno></analytic><monogr><title level="j">Jour</title><imprint><date type="published" when="2010-03"/></imprint></monogr></biblStruct>
<biblStruct><monogr><title level="m">A book of things</title><imprint><date type="published" when="1999"/></imprint></monogr></biblStruct>
<biblStruct><monogr><imprint/></monogr></biblStruct></listBibl></text></TEI>"""


def test_tei_and_matching(spark):
    refs = landed.tei_references(spark.createDataFrame([("a", TEI), ("b", "<TEI><broken")], "path string, xml string"))
    got = [(r.ord, r.title, r.surnames, r.year, r.journal, r.doi) for r in refs.orderBy("ord").collect()]
    assert got == [(0, "First paper", ["Cook"], 2010, "Jour", "10.1000/f"), (1, "A book of things", [], 1999, None, None)]
    cand = spark.createDataFrame([("a", 1, 0, "10.1/bad", 90.0, "Other", 1999), ("a", 1, 1, "10.1000/BK", 80.0, "A book of thing", 2000), ("a", 1, 2, "10.1000/no", 99.0, "A book of things", 2005), ("a", 1, 3, "10.1000/low", 10.0, "A book of things", 1999)], "path string, ord int, cand_ord int, doi string, score double, title string, year int")
    m = {r.ord: (r.doi, r.confidence) for r in landed.match_references(refs, cand).collect()}
    w = {r.title: (r.key, r.unresolved, r.source_ids) for r in landed.tei_works(landed.match_references(refs, cand)).collect()}
    assert w["First paper"] == ("doi:10.1000/f", False, {"grobid_confidence": "100.0"}) and w["A book of things"][0] == "doi:10.1000/bk"
    assert m[0] == ("10.1000/f", 100.0) and m[1][0] == "10.1000/bk" and 90 < m[1][1] < 100


def test_graph_and_aliases(spark, tmp_path):
    g = {"works": {"s": {"title": "S", "year": 2020, "doi": "10.1/s", "source_ids": {"openalex": "W1"}}, "a": {"title": "A"}}, "references": {"s": ["a", "a"]}, "citations": {"a": ["s"]}}
    (tmp_path / "g.json").write_text(json.dumps(g, indent=1))
    works, edges = files.graph(spark, f"file://{tmp_path}/g.json")
    assert sorted((w.key, w.title_norm, w.unresolved) for w in works.collect()) == [("a", "", False), ("s", "", False)]
    assert sorted((e.src, e.dst, e.direction) for e in edges.collect()) == [("a", "s", "forward"), ("s", "a", "backward")]
    idents = spark.createDataFrame([("10.1/s",), ("doi:10.1/s",), ("openalex:w1",), ("W1",), ("none",)], "ident string")
    assert {r.ident: r.key for r in files.resolve_identifiers(idents, files.aliases(works)).collect()} == {"10.1/s": "s", "doi:10.1/s": "s", "openalex:w1": "s", "W1": "s", "none": None}


def test_lists(spark, tmp_path):
    (tmp_path / "seeds.txt").write_text("# seeds\n10.1/a\n\n  W5 \n10.1/a\n")
    assert sorted(r.ident for r in files.seeds(spark, f"file://{tmp_path}/seeds.txt").collect()) == ["10.1/a", "W5"]
    (tmp_path / "labels.csv").write_text("key,decision,note\na,Include,\nb,,\n,exclude,\na,exclude,again\n")
    assert [tuple(r) for r in files.labels(spark, f"file://{tmp_path}/labels.csv").collect()] == [("a", "exclude")]
    (tmp_path / "m.csv").write_text("﻿Title,DOI\nx,https://doi.org/10.1/A\ny,\nz,10.1/a.\n")
    members, n = files.membership(spark, f"file://{tmp_path}/m.csv", "scopus", "DOI")
    assert [tuple(r) for r in members.collect()] == [("scopus", "10.1/a")] and n == {"rows": 3, "without_doi": 1}
    with pytest.raises(ValueError, match="title"):
        files.membership(spark, f"file://{tmp_path}/m.csv", "scopus", "isbn")
    (tmp_path / "gold.json").write_text(json.dumps({"included": [{"key": "k"}, {"doi": "10.1000/X"}, {"title": "T", "year": "2001", "author": "Cook"}]}))
    keys = sorted(r.key for r in files.gold(spark, f"file://{tmp_path}/gold.json").collect())
    assert keys[:2] == ["doi:10.1000/x", "k"] and keys[2].startswith("sig:")
    assert files.providers({"crossref": True, "openalex": True}) == ["openalex", "crossref"] and files.providers({}, True) == ["offline"]


def test_cache_scan_and_integrity(spark, tmp_path):
    import hashlib

    body, params = {"id": "W1", "b": [1]}, {"z": 1, "a": "é"}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    key = sha(f"openalex|get|{canonical(params)}")
    for name, b in ((key, body), ("ff00", {"id": "changed"})):
        (tmp_path / name[:2]).mkdir(exist_ok=True)
        entry = {"cache_key": name, "provider": "openalex", "method": "get", "params": params, "http_status": 200, "response_hash": "sha256:" + sha(canonical(body)), "body": b}
        (tmp_path / name[:2] / f"{name}.json").write_text(json.dumps(entry))
    got = {r.cache_key: (r.key_ok, r.body_ok) for r in verify.integrity(files.cache(spark, f"file://{tmp_path}")).collect()}
    assert got == {key: (True, True), "ff00": (False, False)}


def test_drift_classes(spark):
    base = {"id": "W1", "title": "t", "is_retracted": False, "referenced_works": ["A", "B"]}
    news = {
        "same": base, "gone": None, "retracted": base | {"is_retracted": True}, "merged": base | {"id": "W2"}, "more": base | {"referenced_works": ["A", "B", "C"]},
        "less": base | {"referenced_works": ["A"]}, "both": base | {"referenced_works": ["A", "C"]}, "meta": base | {"title": "u"},
    }
    old = spark.createDataFrame([(k, "p", canonical(base)) for k in news], "cache_key string, provider string, body string").withColumn("response_hash", S.response_hash(F.col("body")))
    new = spark.createDataFrame([(k, 404 if v is None else 200, v and json.dumps(v, indent=1)) for k, v in news.items()], "cache_key string, http_status int, body string")
    d = verify.classify(old, new)
    got = {r.cache_key: r["class"] for r in d.collect()}
    assert got == {"same": "unchanged", "gone": "deindexed", "retracted": "retracted", "merged": "merged", "more": "new_citing", "less": "lost_citing", "both": "new_citing", "meta": "metadata_changed"}
    assert {r.cache_key: r.changed_fields for r in d.collect()}["meta"] == ["title"] and not verify.ok(d)
    assert sum(r.n for r in verify.drift_counts(d).where("provider is null").collect()) == 8


def works_row(spark):
    author = "array<struct<surname:string,given:string,orcid:string>>"
    prov = "array<struct<provider:string,direction:string,parent_key:string,iteration:int,retrieved_at:string,response_hash:string>>"
    rows = [("k1", "The Title here", [("Cook", "A", None)], 2001, "J", "book", "10.1/a", None, [("p", "backward", "k0", 1, "", "")]), ("k2", "The title again", [("Cook", "B", None)], 2001, "J", None, None, "abs", [("q", "forward", "k0", 1, "", "")]), ("k3", "On", [], None, None, None, None, None, [])]
    return spark.createDataFrame(rows, f"key string, title string, authors {author}, year int, venue string, type string, doi string, abstract string, provenance {prov}")


def test_exports(spark, tmp_path):
    w = works_row(spark)
    assert {r.key: r.bibkey for r in exports.bibtex_keys(w).collect()} == {"k1": "cook2001title", "k2": "cook2001titleb", "k3": "anonnd"}
    ris = {r.key: r.entry for r in exports.ris(w).collect()}
    assert ris["k1"].split("\n") == ["TY  - BOOK", "TI  - The Title here", "AU  - Cook, A", "PY  - 2001", "JO  - J", "DO  - 10.1/a", "ID  - k1", "ER  - "]
    edges = {(r.u, r.v) for r in exports.citation_edges(w).collect()}
    assert edges == {("k0", "k1"), ("k2", "k0")}
    exports.write_graphml(w, exports.citation_edges(w), (tmp_path / "g.graphml").as_uri())
    xml = ElementTree.fromstring((tmp_path / "g.graphml").read_text())
    assert [e.tag.rpartition("}")[2] for e in xml[-1]] == ["node"] * 3 + ["edge"] * 2
    scores = spark.createDataFrame([("k1", 0.5), ("k2", 0.5), ("k3", 1.0)], "key string, score double")
    c = exports.candidates(w, scores).collect()
    assert [(r["rank"], r.key, r.score) for r in c] == [(1, "k3", "1.000000"), (2, "k1", "0.500000"), (3, "k2", "0.500000")] and len(c[0]) == 13
    assert exports.flow_svg({"identified": 3}).startswith("<svg") and "@article{cook2001title," in exports.bibtex(w).collect()[0].entry
    assert exports.audit_line("x", b=1, a="é") == '{"a": "é", "b": 1, "event": "x"}'


def test_ordered_files(spark, tmp_path):
    """Many parts in one file, in order, under a header and over a footer; written anew, and with no row at all."""
    rows = [(k * 7919 % 5000, f"line {k * 7919 % 5000:05} é\nof two") for k in range(5000)]
    df = spark.createDataFrame(rows, "k int, line string").repartition(9)
    path = tmp_path / "out.txt"
    for part in (df.where("k < 10"), df):
        exports.write_ordered(part, ["k"], path.as_uri(), "head\n", "foot\n")
    assert path.read_text() == "head\n" + "".join(f"line {k:05} é\nof two\n" for k in range(5000)) + "foot\n"
    exports.write_ordered(df.limit(0), ["k"], path.as_uri(), "head\n", "foot\n")
    assert path.read_text() == "head\nfoot\n"
    assert [f.name for f in tmp_path.iterdir() if not f.name.endswith(".crc")] == ["out.txt"]


def test_graphml_of_odd_texts(spark, tmp_path):
    """Marks, quotes, controls, line ends and nulls in keys and titles; a parser reads them back."""
    nodes = spark.createDataFrame([("a<b", 'x & "y"'), ("c", None), ("d", "one\ntwo\x0bthree")], "key string, title string")
    edges = spark.createDataFrame([("a<b", "c", "p&q"), ("c", "d", None)], "u string, v string, provider string")
    exports.write_graphml(nodes, edges, (tmp_path / "g.xml").as_uri())
    graph = ElementTree.fromstring((tmp_path / "g.xml").read_text())[-1]
    assert [(n.get("id"), n[0].text) for n in graph if n.get("id")] == [("a<b", 'x & "y"'), ("c", None), ("d", "one twothree")]
    assert [(e.get("source"), e.get("target"), e[0].text) for e in graph if e.get("source")] == [("a<b", "c", "p&q"), ("c", "d", None)]


def test_label_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.csv").write_text("key,decision,note,ts\na,Include,,2024-01-01T00:00:00\nb,exclude,,2024-01-01T00:10:00\n")
    (src / "2.csv").write_text("key,decision,note,ts\na,exclude,,2024-01-01T02:00:00\n,x,,\n")
    stream = L.label_stream(spark, f"file://{src}")
    q = L.write_latest(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/cp")
    q.awaitTermination()
    last = max(p.name for p in (tmp_path / "out").iterdir())
    got = {r.key: r.decision for r in spark.read.parquet(f"file://{tmp_path}/out/{last}").collect()}
    assert got == {"a": "exclude", "b": "exclude"}
    q = L.rates(stream).writeStream.outputMode("complete").format("memory").queryName("rates").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sum(r.n_screened for r in spark.table("rates").collect()) == 3


def test_bibtex_keys_beyond_char(spark):
    """The letters of equal keys go on beyond the 256th: no key comes twice."""
    from citeweft.sinks import exports
    from pyspark.sql import functions as F

    works = spark.range(600).select(F.format_string("k%04d", "id").alias("key"), F.array(F.struct(F.lit("Cook").alias("surname"))).alias("authors"), F.lit(2000).alias("year"), F.lit("Some title").alias("title"))
    got = [r.bibkey for r in exports.bibtex_keys(works).orderBy("key").collect()]
    assert len(set(got)) == 600 and got[1] == got[0] + "b" and got[-1] == got[0] + chr(96 + 600)
