"""Citation providers as a data source of Spark: ``spark.read.format("citation_edges").load(path)``.

A provider's landed pages are JSON lines {"key": ..., "references": [...], "citations": [...]} in folders
``provider=NAME`` under the path; a folder may hold many files, and each file is a partition of the read. Rows are edges
(src, dst, direction, provider): references backward, citations forward. Conditions on provider and direction are pushed
down: folders of other providers are not listed, and pages' other side is not unfolded. A source that a user writes keeps to
the same four columns and registers under a name of its own with ``register``.

Files are opened through Arrow, by the path's scheme (file, hdfs, s3, gs), wherever a task runs. Lines that are no JSON
object fail the read; null or missing lists give no edge; null ends are left out.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull

DDL = "src string, dst string, direction string, provider string"
SCHEMA = pa.schema([(c.split()[0], pa.string()) for c in DDL.split(", ")])
SIDES = {"backward": "references", "forward": "citations"}
#: Edges that leave in one batch.
BATCH = 1 << 16


@dataclass
class Page(InputPartition):
    """One file of one provider."""

    path: str
    provider: str


class EdgeReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path
        self.wanted: dict[str, set[str]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802  Spark's name
        """Takes equality and membership on provider and direction, which are never null; Spark tests all others."""
        for f in filters:
            if isinstance(f, IsNotNull) and f.attribute in (("provider",), ("direction",)):
                continue
            name = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if name in ("provider", "direction"):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[name] = self.wanted[name] & values if name in self.wanted else values
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        system, root = fs.FileSystem.from_uri(self.path)
        out: list[InputPartition] = []
        for folder in sorted(system.get_file_info(fs.FileSelector(root)), key=lambda x: x.path):
            name = folder.base_name.partition("provider=")[2]
            if folder.type != fs.FileType.Directory or not name or ("provider" in self.wanted and name not in self.wanted["provider"]):
                continue
            files = system.get_file_info(fs.FileSelector(folder.path, recursive=True))
            out += [Page(f.path, name) for f in sorted(files, key=lambda x: x.path) if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))]
        return out or [Page("", "")]

    def read(self, partition: Page) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        system, _ = fs.FileSystem.from_uri(self.path)
        sides = {d: c for d, c in SIDES.items() if d in self.wanted.get("direction", SIDES)}
        rows: list[tuple] = []
        with system.open_input_stream(partition.path) as f:
            for line in _lines(f):
                page = json.loads(line)
                for direction, column in sides.items():
                    rows += [(page.get("key"), other, direction, partition.provider) for other in page.get(column) or () if other is not None and page.get("key") is not None]
                if len(rows) >= BATCH:
                    yield _batch(rows)
                    rows = []
        if rows:
            yield _batch(rows)


def _lines(stream: pa.NativeFile) -> Iterator[bytes]:
    """The lines of a stream that say something, a block of bytes at a time."""
    rest = b""
    while block := stream.read(1 << 20):
        *whole, rest = (rest + block).split(b"\n")
        yield from (x for x in whole if x.strip())
    if rest.strip():
        yield rest


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], schema=SCHEMA)


class EdgeSource(DataSource):
    """Landed pages of providers as edges."""

    @classmethod
    def name(cls) -> str:
        return "citation_edges"

    def schema(self) -> str:
        return DDL

    def reader(self, schema: object) -> DataSourceReader:
        path = self.options.get("path")
        if not path:
            raise ValueError("citation_edges needs a path")
        return EdgeReader(path)


def register(spark: SparkSession, source: type[DataSource] = EdgeSource) -> str:
    """Makes a source known to the session, with pushed filters; its name. Sources must give the columns of edges."""
    probe = source({"path": "file:///"})
    columns = [c.split()[0] for c in str(probe.schema()).split(",")]
    if columns != SCHEMA.names:
        raise ValueError(f"source {source.name()!r} gives {', '.join(columns)}, not {', '.join(SCHEMA.names)}")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(source)
    return source.name()


def edges(spark: SparkSession, path: str, name: str = "citation_edges") -> DataFrame:
    """Edges of a registered source, without repeats."""
    return spark.read.format(name).load(path).distinct()
