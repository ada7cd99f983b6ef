"""The state machine, and the registry against its SQL."""

from __future__ import annotations

import os

import duckdb
import pytest
from citeweft.model import WORKS_DDL, Arm, Eligibility, RunSettings
from citeweft.plans import queries as Q
from citeweft.run import LabelError, Run
from pyspark.sql import functions as F

YEARS = {"seed": 2021, "a": 2012, "b": 2014, "c": 2016, "d": 2018, "e": 2019, "f": 2020, "u": 2015}
BACK = [("seed", "a"), ("seed", "b"), ("seed", "c"), ("a", "d"), ("b", "e"), ("u", "f")]
FORWARD = [("c", "f"), ("seed", "u")]


@pytest.fixture(scope="module")
def graph(spark):
    rows = [(k, f"title of {k} {k}", f"title of {k} {k}", f"10.1000/{k}", None, y, [(f"s{k}", None, None)], None, "article", "en", False, k == "u", {}, None, None, []) for k, y in YEARS.items()]
    edges = [(s, t, "backward", "p1") for s, t in BACK] + [(s, t, "forward", "p2") for s, t in FORWARD]
    return spark.createDataFrame(rows, WORKS_DDL), spark.createDataFrame(edges, "src string, dst string, direction string, provider string")


def start(spark, graph, **settings):
    run = Run(*graph, RunSettings(**{"max_iterations": 6, "eligibility": Eligibility(year_min=2000)} | settings))
    assert run.init(spark.createDataFrame([("10.1000/seed",), ("unknown",)], "ident string")) == 1
    return run


def take_all(candidates):
    return candidates.select("key", F.lit("include").alias("decision"))


def test_saturation(spark, graph):
    run = start(spark, graph, arms=(Arm("p1", providers=("p1",)), Arm("p2", providers=("p2",))))
    run.run_to_saturation(take_all)
    assert run.stopped_by == "exhaustion"
    # u is not resolved: it is found, but never expanded; f comes by c
    assert {r.key for r in run.decisions.collect()} == set(YEARS)
    assert [(r["n"], r["n_screened"]) for r in run.rounds] == [(1, 4), (2, 3), (3, 0)]
    assert not run.estimate()["estimable"]
    assert run.counts()["included"] == 7 and run.counts()["seeds"] == 1
    assert "# Citation search report" in run.report() and any('"unresolved": 1' in e for e in run.events)


def test_steps_are_idempotent_and_labels_checked(spark, graph):
    run = start(spark, graph)
    first = [tuple(r) for r in run.step().orderBy("rank").collect()]
    assert [tuple(r) for r in run.step().orderBy("rank").collect()] == first
    for bad, why in (([("zzz", "include")], "do not wait"), ([("a", "maybe")], "neither"), ([("a", "")], "says anything")):
        with pytest.raises(LabelError, match=why):
            run.label(spark.createDataFrame(bad, "key string, decision string"))
    run.label(spark.createDataFrame([("a", "include"), ("b", "exclude")], "key string, decision string"))
    assert run.phase == "ready"
    again = {r.key for r in run.step().collect()}
    assert again == {"d"}  # c and u wait for another discovery


def test_rejected_and_budget(spark, graph):
    run = start(spark, graph, eligibility=Eligibility(year_min=2013), rules=(("budget", {"max_screened": 2}),))
    run.run_to_saturation(take_all)
    assert run.stopped_by == "budget" and {"iteration": 1, "reason": "year_below_min", "n": 1} in run.rejected


def test_save_and_load(spark, graph, tmp_path):
    run = start(spark, graph)
    run.step()
    run.save(f"file://{tmp_path}/s")
    other = Run.load(f"file://{tmp_path}/s", *graph, run.settings)
    assert other.phase == "awaiting_labels" and sorted(map(tuple, other.step().collect())) == sorted(map(tuple, run.pending.collect()))
    run.run_to_saturation(take_all)
    other.run_to_saturation(take_all)
    assert other.rounds == run.rounds


DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = ["norm_title", "canonical_key", "snowball_history", "dedup_clusters", "merge_records", "bm25_rank", "network_rank", "embedding_centroid_rank", "chapman_estimate", "chao1_estimate", "conditional_odds", "ruleset_decision", "stopping_outcomes", "icc21", "auc_rank", "tfidf_centroid", "drift_counts", "cache_integrity", "bibtex_keys", "alias_lookup"]


def plain(rows):
    return sorted(repr(tuple(round(x, 6) + 0.0 if isinstance(x, float) else x for x in r)) for r in rows)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", CHECKED)
def test_queries_agree_with_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    out = Q.QUERIES[name](spark, DATA)
    names = sorted(out.columns)
    cur = con.execute(Q.SQL[name])
    theirs = [c[0] for c in cur.description]
    assert sorted(theirs) == names
    rows = [tuple(r[theirs.index(c)] for c in names) for r in cur.fetchall()]
    assert plain(tuple(r[c] for c in names) for r in out.collect()) == plain(rows)


def test_registry():
    import __spark_entry__ as entry

    found, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(found) and len(Q.QUERIES) > 85 and set(Q.QUERIES) <= set(found)


def test_crawl_is_the_same_for_any_partitioning(spark):
    got = set()
    for n in ("1", "4", "13"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.add(repr(sorted(map(tuple, Q.QUERIES["snowball_history"](spark, DATA).collect()))))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(got) == 1


def test_two_providers_make_one_work(spark):
    """Both providers' records of a paper become one work, with the better fields, and its edges are followed from either."""
    author = [("stone", None, None)]
    row = lambda key, title, doi, abstract, provider: (key, title, title, doi, abstract, 2020, author, None, "article", "en", False, False, {provider: key}, None, None, [(provider, "backward", "seed", 1, "", "")])
    title = "a study of citation graphs in the large"
    rows = [row("seed", "seed", "10.1/s", None, "p1"), row("a1", title, "10.1/a", None, "p1"), row("a2", title, None, "what it says of sampling", "p2"), row("b", "something else altogether", "10.1/b", None, "p2"), row("c", "behind the second record", "10.1/c", None, "p2")]
    edges = [("seed", "a1", "backward", "p1"), ("seed", "a2", "backward", "p2"), ("seed", "b", "backward", "p2"), ("a2", "c", "backward", "p2")]
    works, links = spark.createDataFrame(rows, WORKS_DDL), spark.createDataFrame(edges, "src string, dst string, direction string, provider string")
    core = spark.createDataFrame([("a1",), ("c",)], "key string")
    arms = (Arm("p1", providers=("p1",)), Arm("core", member_of="core"))
    with pytest.raises(ValueError, match="membership"):
        Run(works, links, RunSettings(arms=arms))
    with pytest.raises(ValueError, match="vectors"):
        Run(works, links, RunSettings(ranker="embedding"))
    run = Run(works, links, RunSettings(max_iterations=4, arms=arms), members={"core": core})
    run.init(spark.createDataFrame([("10.1/s",)], "ident string"))
    assert {r.key for r in run.step().collect()} == {"a1", "b"}
    one = run.works.where("key = 'a1'").collect()[0]
    assert one.doi == "10.1/a" and one.abstract == "what it says of sampling" and {p.provider for p in one.provenance} == {"p1", "p2"}
    assert run.works.where("key = 'a2'").isEmpty() and run.works.count() == 4
    run.label(take_all(run.pending))
    assert {r.key for r in run.step().collect()} == {"c"}  # found by the other record's edge
    run.label(take_all(run.pending))
    run.estimate()
    assert run.manifest.data["rounds"].keys() == {"1", "2"}


def test_verify_and_snapshot_verbs(tmp_path):
    import json

    from citeweft.__main__ import main

    works = {f"doi:10.1/{k}": {"title": f"title {k}", "title_norm": f"title {k}", "doi": f"10.1/{k}", "year": 2020} for k in "sab"}
    (tmp_path / "graph.json").write_text(json.dumps({"works": works, "references": {"doi:10.1/s": ["doi:10.1/a"], "doi:10.1/a": ["doi:10.1/b"]}, "citations": {}}))
    (tmp_path / "seeds.txt").write_text("10.1/s\n")
    folder = str(tmp_path / "run")
    assert main(["init", folder, "--seeds", str(tmp_path / "seeds.txt"), "--graph", str(tmp_path / "graph.json")]) == 0
    assert main(["verify", folder]) == 0
    assert main(["snapshot", folder, str(tmp_path / "run.tar.gz")]) == 0 and (tmp_path / "run.tar.gz").stat().st_size
    known = json.loads((tmp_path / "run/manifest.json").read_text())
    known["rounds"]["saved"]["decisions"] = "0" * 64
    (tmp_path / "run/manifest.json").write_text(json.dumps(known))
    assert main(["verify", folder]) == 1
