"""Exports: candidate lists, RIS, BibTeX, GraphML, flow diagram, report, audit log."""

from __future__ import annotations

import json
import uuid
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import rank
from ..storage import shared_dir

# Types of works in RIS; others are journal articles.
RIS_TYPES = {"article": "JOUR", "journal-article": "JOUR", "book": "BOOK", "book-chapter": "CHAP", "proceedings-article": "CPAPER", "dissertation": "THES", "report": "RPRT", "preprint": "UNPB"}


def _names() -> Column:
    """Authors as Surname, Given."""
    return F.transform("authors", lambda a: F.concat_ws(", ", a["surname"], S.present(a["given"])))


def _listed(field: str) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform("provenance", lambda p: p[field]), lambda x: x.isNotNull()))), "|")


def candidates(works: DataFrame, scores: DataFrame) -> DataFrame:
    """The candidate list in order of rank, 13 columns of text."""
    rows = works.join(rank.positions(scores.select("key", "score")), "key")
    return rows.select(
        "rank",
        "key",
        F.format_string("%.6f", "score").alias("score"),
        "title",
        F.array_join(_names(), "|").alias("authors"),
        "year",
        "venue",
        "type",
        "doi",
        "abstract",
        _listed("provider").alias("providers"),
        _listed("direction").alias("directions"),
        _listed("parent_key").alias("parents"),
    ).orderBy("rank")


def labels_template(ranked: DataFrame) -> DataFrame:
    return ranked.select("key", F.lit("").alias("decision"), F.lit("").alias("note"))


def ris(works: DataFrame) -> DataFrame:
    """(key, entry): a RIS record for each work."""
    kinds = F.create_map(*(F.lit(x) for kv in RIS_TYPES.items() for x in kv))
    line = lambda tag, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{tag}  - "), c))
    authors = F.array_join(F.transform(_names(), lambda n: F.concat(F.lit("AU  - "), n)), "\n")
    entry = F.concat_ws(
        "\n",
        F.concat(F.lit("TY  - "), F.coalesce(F.try_element_at(kinds, F.coalesce("type", F.lit(""))), F.lit("JOUR"))),
        line("TI", F.col("title")),
        S.present(authors),
        line("PY", F.col("year").cast("string")),
        line("JO", F.col("venue")),
        line("DO", F.col("doi")),
        line("AB", F.col("abstract")),
        F.concat(F.lit("ID  - "), "key"),
        F.lit("ER  - "),
    )
    return works.select("key", entry.alias("entry")).orderBy("key")


def bibtex_keys(works: DataFrame) -> DataFrame:
    """(key, bibkey): equal keys get b, c, … in order of the works' keys."""
    base = S.bib_key(F.get("authors", F.lit(0))["surname"], F.col("year"), F.col("title"))
    rows = works.select("key", base.alias("base")).withColumn("n", F.row_number().over(Window.partitionBy("base").orderBy("key")))
    # char() takes its number modulo 256, and would give keys again
    letter = F.decode(F.unhex(F.lpad(F.hex(96 + F.col("n")), 8, "0")), "UTF-32")
    return rows.select("key", F.when(F.col("n") > 1, F.concat("base", letter)).otherwise(F.col("base")).alias("bibkey"))


def bibtex(works: DataFrame) -> DataFrame:
    field = lambda n, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"  {n} = {{"), c, F.lit("}")))
    rows = works.join(bibtex_keys(works), "key")
    kind = F.when(F.coalesce("type", F.lit("")).startswith("proceedings"), "inproceedings").otherwise("article")
    fields = F.concat_ws(",\n", field("title", F.col("title")), field("author", F.array_join(_names(), " and ")), field("year", F.col("year").cast("string")), field("journal", F.col("venue")), field("doi", F.col("doi")))
    return rows.select("key", F.concat(F.lit("@"), kind, F.lit("{"), "bibkey", F.lit(",\n"), fields, F.lit("\n}")).alias("entry")).orderBy("key")


def citation_edges(works: DataFrame) -> DataFrame:
    """(u, v, provider, direction): citing to cited, from the works' provenance; of repeated ones the last."""
    p = works.select("key", F.explode("provenance").alias("p")).where("p.parent_key is not null")
    back = F.col("p.direction") == "backward"
    rows = p.select(F.when(back, F.col("p.parent_key")).otherwise(F.col("key")).alias("u"), F.when(back, F.col("key")).otherwise(F.col("p.parent_key")).alias("v"), F.struct("key", "p").alias("ord"), "p.provider", "p.direction")
    return rows.groupBy("u", "v").agg(F.max_by(F.struct("provider", "direction"), "ord").alias("x")).select("u", "v", "x.*")


def write_ordered(lines: DataFrame, order: list[str], path: str, header: str = "", footer: str = "") -> None:
    """One text file at ``path``: the header, the column ``line`` of all rows in order, the footer.

    Rows are dealt by ranges of the order and written in parts by their tasks, so that parts in turn are the whole. The
    driver then copies one part after another, as a stream of bytes, into a file beside ``path`` that takes its name at the
    end: it never holds rows, and a reader sees the whole file or none. An existing file is replaced.
    """
    spark = lines.sparkSession
    parts = f"{shared_dir(spark)}/citeweft/{uuid.uuid4().hex}"
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("line").write.text(parts)
    hadoop, conf = spark._jvm.org.apache.hadoop, spark._jsc.hadoopConfiguration()
    source, final, half = hadoop.fs.Path(parts), hadoop.fs.Path(path), hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    there, here = source.getFileSystem(conf), final.getFileSystem(conf)
    out = here.create(half, True)
    try:
        out.write(header.encode())
        for name in sorted(str(f.getPath().getName()) for f in there.listStatus(source)):
            if name.startswith("part-"):
                part = there.open(hadoop.fs.Path(source, name))
                try:
                    hadoop.io.IOUtils.copyBytes(part, out, 1 << 20, False)
                finally:
                    part.close()
        out.write(footer.encode())
    finally:
        out.close()
    here.delete(final, False)
    if not here.rename(half, final):
        raise OSError(f"{path} could not be written")
    there.delete(source, True)


GRAPHML_HEAD = "\n".join(
    [
        '<?xml version="1.0" encoding="UTF-8"?>',
        '<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="t" for="node" attr.name="title" attr.type="string"/>',
        '<key id="p" for="edge" attr.name="provider" attr.type="string"/>',
        '<graph edgedefault="directed">\n',
    ]
)
GRAPHML_FOOT = "</graph>\n</graphml>\n"


def _xml(c: Column) -> Column:
    """Text for a line of XML: marks as entities, line ends as blanks, without the controls that XML has no place for."""
    text = F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(mark), F.lit(entity))
    return F.regexp_replace(text, r"[\r\n\t]+", " ")


def graphml_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, a, b, line): a line for each node (key, title) and each edge (u, v, provider), nodes first."""
    n = nodes.select(F.lit(0).alias("kind"), F.col("key").alias("a"), F.lit(None).cast(dict(nodes.dtypes)["key"]).alias("b"), F.concat(F.lit('<node id="'), _xml(F.col("key")), F.lit('"><data key="t">'), _xml(F.col("title")), F.lit("</data></node>")).alias("line"))
    e = edges.select(F.lit(1), "u", "v", F.concat(F.lit('<edge source="'), _xml(F.col("u")), F.lit('" target="'), _xml(F.col("v")), F.lit('"><data key="p">'), _xml(F.col("provider")), F.lit("</data></edge>")))
    return n.union(e)


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A GraphML file of nodes (key, title) and edges (u, v, provider), in order, of any size."""
    write_ordered(graphml_lines(nodes, edges), ["kind", "a", "b"], path, GRAPHML_HEAD, GRAPHML_FOOT)


def flow_svg(counts: dict[str, int]) -> str:
    """The flow diagram of identified, screened and included records."""
    boxes = [("Identified", "identified"), ("Duplicates removed", "duplicates"), ("Not eligible", "ineligible"), ("Screened", "screened"), ("Excluded", "excluded"), ("Included", "included")]
    out = ['<svg xmlns="http://www.w3.org/2000/svg" width="320" height="440" font-family="sans-serif" font-size="13">']
    for k, (label, name) in enumerate(boxes):
        y = 10 + 70 * k
        out.append(f'<rect x="20" y="{y}" width="280" height="44" fill="none" stroke="black"/><text x="34" y="{y + 27}">{escape(label)}: {counts.get(name, 0)}</text>')
        if k:
            out.append(f'<line x1="160" y1="{y - 26}" x2="160" y2="{y}" stroke="black"/>')
    return "\n".join([*out, "</svg>", ""])


def report(counts: dict[str, int], history: list[dict], estimate: dict, decisions: list[dict]) -> str:
    """The run in Markdown: counts, rounds, estimate and stopping rules."""
    out = ["# Citation search report", "", "| Count | Records |", "|-|-|", *(f"| {k} | {v} |" for k, v in counts.items()), "", "| Round | Screened | Included | Yield |", "|-|-|-|-|"]
    out += [f"| {h['n']} | {h['n_screened']} | {h['n_included']} | {h['yield_rate']:.3f} |" for h in history]
    if estimate.get("estimable"):
        out += ["", f"Estimated population ({estimate['method']}): {estimate['n_hat']:.1f}; recall {estimate['recall']:.3f}."]
    else:
        out += ["", f"No estimate ({estimate.get('method')}): {estimate.get('reason')}."]
    out += ["", *(f"- {d['rule']} in round {d['n']}: {d['rationale']}" for d in decisions if d["triggered"])]
    return "\n".join([*out, ""])


def audit_line(event: str, **fields: object) -> str:
    """One event of the audit log: JSON with sorted keys."""
    return json.dumps({"event": event, **fields}, sort_keys=True, ensure_ascii=False)


def write_one(df: DataFrame, path: str, **options: object) -> None:
    """A sorted DataFrame as one CSV part, so that two runs give the same bytes."""
    df.coalesce(1).write.mode("overwrite").options(header=True, **options).csv(path)
