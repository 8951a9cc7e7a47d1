"""Sinks. Tables are written where they are, in many files. A single file (a JSON list, CSV with a byte-order mark, GEXF) is put together by one task from pieces of about a MB that are made where the rows are; no row goes through the driver.
Its path may name any file system that Hadoop knows and all executors share."""

from __future__ import annotations

import codecs
import csv
import io
import json
import os
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import partial
from xml.sax.saxutils import quoteattr

from pyspark import RDD
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from knotwork.operators.extraction import clean_output
from knotwork.plans.lineage import drop, file_system, keep
from knotwork.plans.schema import to_edge

_PIECE = 1 << 20


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines; null fields are left out."""
    df.write.mode("overwrite").json(path)


class _Text:
    """Text to a Hadoop output stream, some hundred KB at a time."""

    def __init__(self, out):
        self.out, self.held, self.size = out, [], 0

    def write(self, text: str) -> None:
        self.held.append(text)
        self.size += len(text)
        if self.size > 1 << 19:
            self.flush()

    def flush(self) -> None:
        if self.held:
            self.out.write("".join(self.held).encode())
        self.held, self.size = [], 0


@contextmanager
def writing(spark: SparkSession, file: str) -> Iterator[_Text]:
    """A text file (UTF-8) in whatever file system its path names; an existing one is replaced."""
    p, fs = file_system(spark, file)
    out = fs.create(p, True)
    try:
        text = _Text(out)
        yield text
        text.flush()
    finally:
        out.close()


def _pieces(section: int, sep: str, part: int, lines: Iterable[str]) -> Iterator[tuple[int, int, int, str]]:
    """(section, part, k, value): a partition's lines, joined to about a MB each."""
    held, size, k = [], 0, 0
    for x in lines:
        held.append(x)
        size += len(x)
        if size > _PIECE:
            yield section, part, k, sep.join(held)
            held, size, k = [], 0, k + 1
    if held:
        yield section, part, k, sep.join(held)


def write_lines(spark: SparkSession, file: str, *sections: str | RDD[str], between: str = "", end: str = "\n") -> None:
    """One text file of given lines and RDDs of lines, in order; each line has `end`, and those of an RDD but its last have `between` before it. An existing file is replaced."""
    sc = spark.sparkContext
    made = [sc.parallelize([(i, 0, 0, x)], 1) if isinstance(x, str) else x.mapPartitionsWithIndex(partial(_pieces, i, between + end)) for i, x in enumerate(sections)]
    pieces, path = keep(spark.createDataFrame(sc.union(made), "section int, part int, k int, value string", verifySchema=False), "pieces")
    at = F.struct("section", "part", "k")
    last = [r.last for r in pieces.groupBy("section").agg(F.max(at).alias("last")).collect()]  # one a section
    is_last = F.col("at").isin([F.struct(*(F.lit(v).cast("int").alias(n) for n, v in r.asDict().items())) for r in last])
    lines = pieces.coalesce(1).sortWithinPartitions("section", "part", "k").select("value", at.alias("at")).select(F.when(is_last, F.col("value")).otherwise(F.concat("value", F.lit(between))).alias("value"))
    p, fs = file_system(spark, file)
    p = fs.makeQualified(p)
    folder = spark._jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{p.getName()}-{uuid.uuid4().hex}")
    try:
        lines.write.option("lineSep", end).option("compression", "none").option("maxRecordsPerFile", 0).text(folder.toString())
        (whole,) = (x.getPath() for x in fs.listStatus(folder) if x.getPath().getName().startswith("part-"))
        if fs.exists(p):
            fs.delete(p, False)
        if not fs.rename(whole, p):
            raise OSError(f"{file} can't be written")
    finally:
        fs.delete(folder, True)
        drop(spark, path)


def _json_lines(indent: int, rows: Iterable[Row]) -> Iterator[str]:
    for r in rows:
        yield json.dumps(json.loads(r.j), ensure_ascii=False, indent=indent)


def _csv_lines(rows: Iterable[Row]) -> Iterator[str]:
    for r in rows:
        csv.writer(out := io.StringIO()).writerow(r)
        yield out.getvalue().removesuffix("\r\n")


def write_json_list(df: DataFrame, file: str, indent: int = 4) -> None:
    """One file with a JSON list, in df's order; null fields are left out."""
    rows = df.select(F.to_json(F.struct(*df.columns)).alias("j")).rdd
    write_lines(df.sparkSession, file, "[", rows.mapPartitions(partial(_json_lines, indent)), "]", between=",")


def write_statistics(statistics: DataFrame, file: str) -> None:
    """The one row of merge statistics as a nested document."""
    s = json.loads(statistics.select(F.to_json(F.struct(*statistics.columns)).alias("j")).first().j)
    doc = {"merge_statistics": {k: s[k] for k in s if k.endswith(("records", "count"))}, "merge_efficiency": {k: s[k] for k in s if k.endswith("reduction")}}
    with writing(statistics.sparkSession, file) as out:
        out.write(json.dumps(doc, ensure_ascii=False, indent=4))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, escape='"')


def write_csv_file(df: DataFrame, file: str) -> None:
    """One CSV file with a byte-order mark, without an index."""
    (head,) = _csv_lines([df.columns])
    write_lines(df.sparkSession, file, codecs.BOM_UTF8.decode() + head, df.rdd.mapPartitions(_csv_lines), end="\r\n")


def clean_name(file: str) -> str:
    """Where the six-field form of a result file goes."""
    return f"{os.path.splitext(file)[0]}_clean.json"


def write_clean(triples: DataFrame, file: str) -> str:
    """The six fields with file names, as a JSON list beside a result file."""
    write_json_list(to_edge(clean_output(triples)), to := clean_name(file))
    return to


def write_ids(ids: DataFrame, path: str) -> None:
    """Distinct ids in order, one a line."""
    ids.select("id").distinct().orderBy("id").write.mode("overwrite").text(path)


def _node(n: Row) -> str:
    return f"<node id={quoteattr(n.id)} label={quoteattr(n.label)}/>"


def _edge(numbered: tuple[Row, int]) -> str:
    e, k = numbered
    return f'<edge id="{k}" source={quoteattr(e.src)} target={quoteattr(e.dst)}><attvalues><attvalue for="0" value={quoteattr(e.property)}/></attvalues></edge>'


def write_gexf(nodes: DataFrame, edges: DataFrame, file: str) -> None:
    """A graph as GEXF 1.2, with labels and each edge's property; parallel edges stay."""
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<gexf xmlns="http://www.gexf.net/1.2draft" version="1.2">\n<graph defaultedgetype="directed">\n<attributes class="edge"><attribute id="0" title="property" type="string"/></attributes>\n<nodes>'
    each = edges.select("src", "dst", "property").rdd.zipWithIndex().map(_edge)
    write_lines(nodes.sparkSession, file, head, nodes.select("id", "label").rdd.map(_node), "</nodes>\n<edges>", each, "</edges>\n</graph>\n</gexf>")
