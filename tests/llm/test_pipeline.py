"""The pipeline's stages, each on what the one before it kept, against plain versions."""

from __future__ import annotations

import brute
import corpus_pipeline as P
import numpy as np
import pytest
from citeweft.llm import quality, secret_scan
from citeweft.llm.common import durable, table
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    out = [("documents", table(spark, DATA, "documents"))]
    for name, stage in P.STAGES:
        out.append((name, durable(stage(spark, out[-1][1], DATA))))
    return {name: (df.columns, df.collect()) for name, df in out}


def test_order():
    assert [n for n, _ in P.STAGES] == ["quality_rules", "ngram_jaccard", "secret_scan", "mix_sources", "pack_sequences"]


def test_columns(stages):
    assert all(stages[n][0] == COLUMNS for n, _ in P.STAGES[:-1])


def test_quality(stages):
    before, after = stages["documents"][1], {r.doc_id for r in stages["quality_rules"][1]}
    bad = {r.doc_id for r in before if brute.base_quality(r.text)["base_failed"]}
    assert not bad & after
    # clean prose stays: no symbols, no shouting
    clean = {r.doc_id for r in before if r.doc_id not in bad and not set(r.text) & set("#*$%&|<>!")}
    assert clean <= after


def test_one_of_each_group(stages):
    before = stages["quality_rules"][1]
    want = brute.near_duplicates([(r.doc_id, r.text) for r in before])
    assert {r.doc_id for r in stages["ngram_jaccard"][1]} == {c for _, c in want.values()}


def test_no_secret_is_left(stages):
    before, after = ({r.doc_id: r.text for r in stages[n][1]} for n in ("ngram_jaccard", "secret_scan"))
    assert before.keys() == after.keys()
    for d, t in before.items():
        spans = secret_scan.base_spans(t.encode(), t)
        assert not secret_scan.base_spans(after[d].encode(), after[d]) and (spans or after[d] == t or "[secret]" in after[d])


def test_mix_and_pack(stages):
    docs, mixed = stages["secret_scan"][1], stages["mix_sources"][1]
    size = {r.doc_id: len(brute.WORD.findall(r.text)) for r in docs}
    took: dict = {}
    for r in mixed:
        took[r.doc_id] = took.get(r.doc_id, 0) + len(brute.WORD.findall(r.text))
    assert all(n <= 2 * size[d] for d, n in took.items())
    assert abs(sum(took.values()) - 1.5 * sum(size.values())) <= len({r.source for r in docs})
    pieces = stages["pack_sequences"][1]
    assert sum(r.length for r in pieces) == sum(len(r.ids) for r in pieces)
    assert {r.doc_id for r in pieces} == set(took)
    at = sorted((r.sequence_id * 1024 + r.offset, r.length) for r in pieces)
    assert at[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(at, at[1:], strict=False))


def test_run_is_the_stages(spark, stages):
    got = P.run(spark, DATA)
    key = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32, r.sequence_id, r.offset)
    assert sorted(map(key, got.collect()), key=repr) == sorted(map(key, stages["pack_sequences"][1]), key=repr)


def test_rows_that_break_things(spark):
    """Nulls, repeats and clashing columns through all stages, then no rows at all."""
    good = [" ".join(f"w{k}x{j}" for j in range(80)) for k in range(4)]
    rows = [(1, good[0], "en", "a", 9), (1, good[0], "en", "a", 9), (1, good[1], "en", None, None), (None, good[2], None, "b", 9), (2, None, "en", "a", 0), (3, "", "en", "a", 0), (4, good[3], None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df = df.selectExpr("*", "text as TEXT", "doc_id as size", "lang as k")
    for name, stage in P.STAGES:
        df = durable(stage(spark, df, DATA))
        got = df.collect()
        assert {r.doc_id for r in got} == {1, None, 4}, name
        if name == "ngram_jaccard":
            assert sorted(r.text for r in got) == sorted(good)
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in P.STAGES:
        none = durable(stage(spark, none, DATA))
        assert none.count() == 0, name


def test_formats_of_few_documents_are_redacted(spark):
    """Thirty of 25,000 documents teach a format, of those that a sample by the hash of ids would leave out."""
    ids = spark.range(25_000).select("id", F.pmod(F.xxhash64("id"), F.lit(1 << 20)).alias("h"))
    late = [r.id for r in ids.where(f"h >= {int(0.9 * (1 << 20))}").orderBy("id").limit(31).collect()]
    rng = np.random.default_rng(14)
    key = lambda: "zq" + "".join(rng.choice(list("XQZJKVW"), 10))
    rows = {k: "extraordinarily straightforward documentation, unquestionably uncontroversial understandings" for k in range(25_000)} | {k: f"token: {key()} and more" for k in late[1:]}
    rows[late[0]] = f"see {key()} here"
    docs = spark.createDataFrame([(k, t, "en", "web", len(t)) for k, t in rows.items()], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in P.without_secrets(spark, docs, "").collect()}
    assert got[late[0]] == "see [secret] here" and got[late[1]] == "[secret] and more" and len(got) == 25_000


def test_all_labels_teach_what_is_kept(spark, tmp_path):
    """Sixty of 52,000 labels are bad, of those that a sample of 50,000 by the hash of ids would leave out."""
    hashed = spark.range(52_000).orderBy(F.pmod(F.xxhash64("id"), F.lit(1 << 30)).desc(), F.col("id").desc())
    bad = [r.id for r in hashed.limit(60).collect()]
    text = " ".join(f"w{k}" for k in range(55))
    docs = spark.range(52_000).select(F.col("id").alias("doc_id"), F.when(F.col("id").isin(bad), text + " ##########").otherwise(text).alias("text"))
    docs.select("doc_id", (~F.col("doc_id").isin(bad)).cast("int").alias("quality")).write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id for r in P.keep_quality(spark, docs, str(tmp_path)).select("doc_id").collect()}
    assert got == set(range(52_000)) - set(bad)


def test_quantiles_go_by_all_rows(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate((rng.random(3000), np.zeros(500), -rng.random(200)))
    names = quality.FEATURES
    df = spark.createDataFrame([(k % 3 == 0, *([float(v)] * len(names))) for k, v in enumerate(x)], "bad boolean, " + ", ".join(f"{f} double" for f in names))
    got = quality.quantiles(df, 24)
    want = np.concatenate([np.quantile(x[np.arange(len(x)) % 3 != 0], np.arange(25) / 24), np.quantile(x[::3], np.arange(25) / 24)])
    for f in names:
        assert np.allclose(got[f], want, rtol=0.003, atol=0)
