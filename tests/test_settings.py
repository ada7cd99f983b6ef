"""Settings, manifests, caches, snapshots and the command line."""

from __future__ import annotations

import json

import pytest
from citeweft import __main__ as cli
from citeweft import manifest as M
from citeweft import settings as C
from citeweft.model import Arm, Eligibility, RunSettings
from citeweft.operators import verify

YAML = """
run: {max_iterations: 4, ranker: bm25, unknown: 1}
eligibility: {year_min: 2000, types: [article, journal-article]}
arms: [{name: b, directions: [backward]}, {name: f, directions: [forward]}]
rules: [{name: marginal_yield, eps: 0.02, k: 3}]
"""


def test_settings():
    s = C.from_yaml(YAML)
    assert s.max_iterations == 4 and s.eligibility.types == ("article", "journal-article") and s.rules == (("marginal_yield", {"eps": 0.02, "k": 3}),)
    said = C.warnings(s)
    assert any("journal-article" in w for w in said) and any("by direction" in w for w in said)
    for bad in ("run: {ranker: x}", "run: {directions: [up]}", "rules: [{name: luck}]", "run: {combine: most}"):
        with pytest.raises(C.SettingsError):
            C.from_yaml(bad)
    with pytest.raises(C.SettingsError):
        C.check(RunSettings(arms=(Arm("x", member_of="a"),)), ("b",))


def test_hash_leaves_secrets_out():
    assert C.settings_hash({"a": 1, "mailto": "x"}) == C.settings_hash({"a": 1, "mailto": "y", "api_key": 3})
    assert C.settings_hash(RunSettings()) != C.settings_hash(RunSettings(eligibility=Eligibility(year_min=1)))
    assert C.drift({"a": {"b": 1, "c": 2}}, {"a": {"b": 1, "c": 3, "new": 0}}) == ["a.c: 2 is now 3"]
    assert C.drift({"a": 1}, {}) == ["a: gone"]


def test_manifest(spark, tmp_path):
    f = tmp_path / "x.txt"
    f.write_text("one")
    m = M.Manifest(RunSettings())
    rows = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    h = M.hash_rows(rows)
    assert h == M.hash_rows(rows.repartition(3).select("v", "k")) != M.hash_rows(rows.union(rows.limit(1)))
    m.record(1, works=h)
    m.record(1, works=h)
    m.add_file(f)
    again = M.Manifest.parse(m.text())
    good = M.verify_replay(again, RunSettings(), {1: {"works": h}})
    assert good["ok"]
    f.write_text("two")
    bad = M.verify_replay(again, RunSettings(max_iterations=3), {1: {"works": "sha256:0"}})
    assert not bad["ok"] and bad["files"] and bad["rounds"] == ["1.works"] and bad["settings"] and "differs" in M.report_text(bad)


def test_cache(spark, tmp_path):
    r = spark.createDataFrame([("p", "get", '{"b":1,"a":2}', 200, "2024-01-01", '{"y":1, "x":2}')], "provider string, method string, params string, http_status int, retrieved_at string, body string")
    e = M.cache_entries(r)
    assert verify.integrity(e).where("key_ok and body_ok").count() == 1
    M.write_cache(e, f"file://{tmp_path}/cache")
    assert len(list((tmp_path / "cache").glob("prefix=*"))) == 1
    asked = spark.createDataFrame([("p", "get", '{"a":2,"b":1}'), ("p", "get", "{}")], "provider string, method string, params string")
    assert sorted(x.hit for x in M.lookup(asked, e).collect()) == [False, True]


def test_snapshots_are_the_same(tmp_path):
    d = tmp_path / "d"
    d.mkdir()
    (d / "b").write_text("1")
    (d / "a").write_text("2")
    assert M.snapshot(d, tmp_path / "1.tgz") == ["a", "b"]
    M.snapshot(d, tmp_path / "2.tgz")
    assert (tmp_path / "1.tgz").read_bytes() == (tmp_path / "2.tgz").read_bytes()


def test_command_line(spark, tmp_path, capsys):
    work = lambda k: {"title": f"title {k}", "title_norm": f"title {k}", "year": 2010, "doi": f"10.1000/{k}"}
    (tmp_path / "g.json").write_text(json.dumps({"works": {k: work(k) for k in "sabc"}, "references": {"s": ["a", "b"], "a": ["c"]}, "citations": {}}))
    (tmp_path / "seeds").write_text("10.1000/s\n")
    (tmp_path / "gold.csv").write_text("key\na\nc\n")
    d = str(tmp_path / "run")
    assert cli.main(["init", d, "--seeds", str(tmp_path / "seeds"), "--graph", str(tmp_path / "g.json")]) == 0
    assert cli.main(["step", d]) == 0
    (tmp_path / "bad.csv").write_text("key,decision\nzzz,include\n")
    assert cli.main(["label", d, str(tmp_path / "bad.csv")]) == 2
    (tmp_path / "ok.csv").write_text("key,decision\na,include\nb,exclude\n")
    assert cli.main(["label", d, str(tmp_path / "ok.csv")]) == 0
    assert cli.main(["run", d, str(tmp_path / "gold.csv")]) == 0
    assert cli.main(["step", d]) == 4 and cli.main(["status", d]) == 0 and cli.main(["estimate", d]) == 0
    assert cli.main(["report", d]) == 0 and cli.main(["export", d]) == 0
    out = capsys.readouterr().out
    assert '"included": 2' in out and '"phase": "stopped"' in out
    assert (tmp_path / "run" / "graph.graphml").read_text().count("<edge ") == 3 and "TI  - title a" in (tmp_path / "run" / "included.ris").read_text()
    assert cli.main(["status", str(tmp_path / "nowhere")]) == 3
