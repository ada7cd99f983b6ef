"""Deduplication: tiers, clusters, merges; the same whatever the order and the partitions."""

from __future__ import annotations

import random

from citeweft.model import DedupSettings
from citeweft.operators import resolve
from citeweft.operators.graph import clusters
from pyspark.sql import functions as F

DDL = "key string, title_norm string, year int, surname string, doi string"


def reps(spark, rows, **settings):
    labels, found = resolve.resolve(spark.createDataFrame(rows, DDL), DedupSettings(**settings))
    return {r.key: (r.rep, r.suspicious) for r in labels.collect()}, {(r.a, r.b): r.tier for r in found.collect()}


def test_tiers(spark):
    title = "a long enough title about something"
    rows = [
        ("a1", title, 2000, "cook", "10.1/x"),
        ("a2", "other words", 1990, "li", "10.1/x"),
        ("b1", title, 2000, "amcook", None),
        ("c1", title[:-1], 2001, "cook", None),
        ("d1", title, 2000, "", None),
        ("e1", title, 2000, "cook", "10.1/y"),
        ("f1", "", 2000, "cook", None),
        ("f2", "", 2000, "cook", None),
        ("g1", title, None, "cook", None),
    ]
    _, tiers = reps(spark, rows)
    assert tiers[("a1", "a2")] == "T1" and tiers[("a1", "b1")] == "T2" and tiers[("a1", "c1")] == "T3" and tiers[("a1", "d1")] == "T4"
    assert ("a1", "e1") not in tiers and ("f1", "f2") not in tiers and not any("g1" in p for p in tiers)


def test_years_over_a_bucket_border(spark):
    got, _ = reps(spark, [("x", "same title here", 1995, "cook", None), ("y", "same title here", 1996, "cook", None), ("z", "same title here", 1999, "cook", None)])
    assert got == {"x": ("x", False), "y": ("x", False)}


def test_large_clusters_stay_apart(spark):
    got, _ = reps(spark, [(f"k{i:02}", "editorial", 2000, "cook", None) for i in range(15)], max_cluster_size=4)
    assert len(got) == 15 and all(rep == key and bad for key, (rep, bad) in got.items())


def test_order_and_partitions_do_not_matter(spark):
    rng = random.Random(1)
    rows = [(f"k{i:03}", rng.choice(["alpha beta gamma", "alpha beta gamme", "delta epsilon", "zeta eta"]) + rng.choice(["", " x", " y z"]), rng.randint(1998, 2003), rng.choice(["cook", "amcook", "", "li"]), rng.choice([None, "10.1/a", "10.1/b"])) for i in range(60)]
    want = None
    for parts in (1, 4, 13):
        rng.shuffle(rows)
        labels, _ = resolve.resolve(spark.createDataFrame(rows, DDL).repartition(parts))
        got = sorted(map(tuple, labels.select("key", "rep", "size", "suspicious").collect()))
        want = want or got
        assert got == want
    assert len({rep for _, rep, *_ in want}) <= len(rows)


def test_merge(spark):
    works = spark.createDataFrame(
        [
            ("b", "", None, "v2", False, True, {"x": "1", "y": "2"}, [("p2", "forward", "q", 1, "", "")]),
            ("a", "T", 2001, None, False, True, {"x": "9"}, [("p1", "backward", "q", 1, "", "")]),
            ("c", "U", 2002, "v3", True, False, {}, [("p1", "backward", "q", 1, "", "")]),
            ("z", "Z", None, None, False, False, {}, []),
        ],
        "key string, title string, year int, venue string, is_retracted boolean, unresolved boolean, source_ids map<string,string>, provenance array<struct<provider:string,direction:string,parent_key:string,iteration:int,retrieved_at:string,response_hash:string>>",
    )
    labels = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "a")], "key string, rep string")
    got = {r.key: r for r in resolve.merge(works, labels, ("p2", "p1")).collect()}
    a = got["a"]
    assert (a.title, a.year, a.venue, a.is_retracted, a.unresolved) == ("T", 2001, "v2", True, False)
    assert a.source_ids == {"x": "1", "y": "2"} and [p.provider for p in a.provenance] == ["p1", "p2"] and set(got) == {"a", "z"}


def test_aliases_are_followed(spark):
    chain = spark.createDataFrame([("c", "b"), ("b", "a"), ("y", "x"), ("x", "y")], "key string, rep string")
    flat = resolve.flatten_aliases(chain)
    assert {r.key: r.rep for r in flat.collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
    rows = spark.createDataFrame([("c", 1), ("n", 2)], "key string, v int")
    assert sorted(map(tuple, resolve.apply_aliases(rows, flat).collect())) == [("a", 1), ("n", 2)]


def test_clusters_of_a_long_chain(spark):
    pairs = spark.createDataFrame([(f"k{i:03}", f"k{i + 1:03}") for i in range(40)], "a string, b string")
    assert {r.rep for r in clusters(pairs).collect()} == {"k000"}


def test_same_key_rows(spark):
    df = spark.createDataFrame([("a", "t", 2000, "cook", None)] * 3, DDL)
    assert resolve.candidate_pairs(df).where(F.col("a_key") == F.col("b_key")).count() == 0


def test_links_are_few_and_leave_the_clusters_of_all_pairs(spark):
    """Copies with like, unlike and no DOIs: pairs grow with the square of a group, links do not; pairs are those of the tiers."""
    rng = random.Random(5)
    titles = ["a shared opening of titles one", "a shared opening of titles two", "something else altogether"]
    rows = [(f"k{k:03}", rng.choice(titles), rng.choice([1999, 2000, 2001, None]), rng.choice(["cook", "amcook", "", "li", None]), rng.choice([None, "", f"10.1/{k % 30}"])) for k in range(300)]
    df = spark.createDataFrame(rows, DDL)
    found, few = resolve.matches(df), resolve.links(df)
    assert resolve.links(df.unionByName(df.withColumn("key", F.concat(F.lit("z"), "key")))).count() < 3 * few.count() < 6 * len(rows)
    near = lambda x, y: x[3] and y[3] and (x[3] == y[3] or {x[3], y[3]} == {"cook", "amcook"}) and abs(x[2] - y[2]) <= 1
    star = {d: min(r[0] for r in rows if r[4] == d) for d in {r[4] for r in rows if r[4]}}
    want = {(x[0], y[0], "T1") for x in rows for y in rows if x[4] and x[4] == y[4] and x[0] != y[0] and x[0] == star[x[4]]}
    for i, x in enumerate(rows):
        for y in rows[i + 1 :]:
            if x[2] and y[2] and not (x[4] and y[4] and x[4] != y[4]) and (x[0], y[0], "T1") not in want:
                same = x[1] == y[1]
                if same and near(x, y):
                    want.add((x[0], y[0], "T2"))
                elif near(x, y) and {x[1], y[1]} <= set(titles[:2]):
                    want.add((x[0], y[0], "T3"))
                elif same and x[2] == y[2] and not (x[3] and y[3]):
                    want.add((x[0], y[0], "T4"))
    assert sorted((r.a, r.b, r.tier) for r in found.collect()) == sorted(want)
    assert sorted(map(tuple, clusters(few).collect())) == sorted(map(tuple, clusters(found).collect()))


def test_conflicts_of_fields_make_no_pairs_of_blocks(spark, tmp_path, monkeypatch):
    """Pairs of T1 are looked at by themselves; years far apart in one block of titles, and an empty title, count too."""
    from citeweft.plans import queries

    rows = [(k, text, "en", "src") for k, text in enumerate(["one title\nmore"] * 9 + ["\nno title"] * 9)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(resolve, "candidate_pairs", lambda r: 1 / 0)
    got = sorted(map(tuple, queries.field_conflicts(spark, str(tmp_path)).collect()))
    key = lambda k: f"d:{k:08}"
    near = [(0, 4), (0, 8), (12, 16)]
    assert got == [(key(a), key(b), int(a % 3 != b % 3)) for a, b in near if len({(2000 + a % 3) // 2, (2001 + a % 3) // 2} & {(2000 + b % 3) // 2, (2001 + b % 3) // 2})]
