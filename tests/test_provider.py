"""Landed pages through the data source."""

from __future__ import annotations

import json

import pytest
from citeweft.sources import provider
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource


def landed(tmp_path):
    pages = {
        "a": [[{"key": "k1", "references": ["r1", "r2", None], "citations": ["c1"]}], [{"key": "k2", "references": None}, {"key": None, "references": ["r9"]}]],
        "b": [[{"key": "k1", "references": ["r1"], "citations": ["c2", "c3"]}, {"key": "k1", "references": ["r1"]}]],
        "broken": [],
    }
    for name, files in pages.items():
        folder = tmp_path / f"provider={name}"
        folder.mkdir()
        for k, rows in enumerate(files):
            (folder / f"part-{k}.json").write_text("\n".join(map(json.dumps, rows)) + "\n\n")
    (tmp_path / "provider=broken" / "x.json").write_text("no json")
    (tmp_path / "_SUCCESS").write_text("")
    return tmp_path.as_uri()


def test_edges_and_pushed_filters(spark, tmp_path):
    path = landed(tmp_path)
    provider.register(spark)
    some = spark.read.format("citation_edges").load(path).where(F.col("provider").isin("a", "b") & (F.col("dst") != "c3"))
    assert sorted(map(tuple, some.distinct().collect())) == [("k1", "c1", "forward", "a"), ("k1", "c2", "forward", "b"), ("k1", "r1", "backward", "a"), ("k1", "r1", "backward", "b"), ("k1", "r2", "backward", "a")]
    one = spark.read.format("citation_edges").load(path).where("provider = 'b' and direction = 'forward'")
    assert sorted(r.dst for r in one.collect()) == ["c2", "c3"] and one.rdd.getNumPartitions() == 1  # the other folders are not listed
    plan = one._jdf.queryExecution().optimizedPlan().toString()
    assert "provider" not in plan.split("RelationV2")[0]  # Spark has no test left to do
    assert spark.read.format("citation_edges").load(path).where("provider = 'unheard of'").count() == 0
    with pytest.raises(Exception, match="(?s)JSONDecodeError|Expecting value"):
        spark.read.format("citation_edges").load(path).where("provider = 'broken'").collect()


def test_sources_keep_to_the_columns_of_edges(spark):
    class Other(DataSource):
        @classmethod
        def name(cls):
            return "other_edges"

        def schema(self):
            return "a string, b string"

    with pytest.raises(ValueError, match="other_edges"):
        provider.register(spark, Other)
