"""GFA text as a data source, and its records as typed DataFrames."""

from __future__ import annotations

import gzip
import io

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from pangrove.functions.names import path_name, strict_number
from pangrove.graph import Graph
from pangrove.operators.place import Refusal
from pangrove.plans.storage import written

SPLIT_BYTES = 32 << 20


def _open(path: str):
    fs, name = pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    return fs, name


#: Places of lines in the k-th file of a folder begin here, times k.
FILE_SPAN = 1 << 44
#: Lines in a batch that the reader hands on.
BATCH = 4096


class Stretch(InputPartition):
    def __init__(self, path: str, begin: int, end: int | None, base: int):
        self.path, self.begin, self.end, self.base = path, begin, end, base


class LinesReader(DataSourceReader):
    """Plain files in byte ranges, each from the first line that begins in it; gzip files (by magic bytes) whole.

    A folder is its files in the order of their names.  Lines come in batches.
    """

    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def partitions(self):
        fs, name = _open(self.path)
        files = [name]
        if fs.get_file_info(name).type == pafs.FileType.Directory:
            inside = fs.get_file_info(pafs.FileSelector(name))
            files = sorted(f.path for f in inside if f.is_file and f.size and f.base_name[0] not in "._")
        return [part for k, f in enumerate(files) for part in self._parts(fs, f, k * FILE_SPAN)] or [Stretch(name, 0, 0, 0)]

    def _parts(self, fs, name, base):
        with fs.open_input_file(name) as f:
            if f.read(2) == b"\x1f\x8b":
                return [Stretch(name, 0, None, base)]
            size = f.size()
        return [Stretch(name, k, min(size, k + self.split), base) for k in range(0, max(1, size), self.split)]

    def _lines(self, part):
        fs = _open(self.path)[0]
        if part.end is None:
            with fs.open_input_stream(part.path, compression=None) as raw, gzip.open(raw) as f:
                at = 0
                for line in f:
                    yield at, line
                    at += len(line)
            return
        if part.begin >= part.end:
            return
        with fs.open_input_file(part.path) as f:
            at = part.begin
            f.seek(max(0, at - 1))
            buffered = io.BufferedReader(f, 1 << 20)
            if at:  # a line that begins before belongs to the stretch before
                at += len(buffered.readline()) - 1
            while at < part.end:
                line = buffered.readline()
                if not line:
                    break
                yield at, line
                at += len(line)

    def read(self, part):
        import pyarrow as pa

        places, texts = [], []
        for at, line in self._lines(part):
            places.append(part.base + at)
            texts.append(line.rstrip(b"\r\n").decode("utf-8", "replace"))
            if len(texts) == BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array(texts, pa.string())], names=["pos", "line"])
                places, texts = [], []
        if texts:
            yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array(texts, pa.string())], names=["pos", "line"])


class GfaSource(DataSource):
    """``spark.read.format("gfa").load(path)``: ``(pos bigint, line string)``, pos being the line's byte offset."""

    @classmethod
    def name(cls):
        return "gfa"

    def schema(self):
        return "pos bigint, line string"

    def reader(self, schema):
        return LinesReader(self.options["path"], int(self.options.get("splitBytes", SPLIT_BYTES)))


def read_lines(spark: SparkSession, path: str, split: int = SPLIT_BYTES) -> DataFrame:
    spark.dataSource.register(GfaSource)
    return spark.read.format("gfa").option("splitBytes", str(split)).load(path)


def _tag(cols, prefix: str, from_col: int):
    """The last tag of a kind among a line's columns."""
    found = F.filter(F.slice(cols, from_col, F.greatest(F.size(cols) - from_col + 1, F.lit(0))), lambda c: F.startswith(c, F.lit(prefix)))
    return F.substring(F.try_element_at(found, F.lit(-1)), F.lit(len(prefix) + 1), F.lit(1 << 30))


def parse_gfa(lines: DataFrame, check: bool = True) -> Graph:
    """A graph of ``(pos, line)`` text: S, L, P and W lines, others ignored.

    Node ids stay text.  A ``*`` sequence takes its length from ``LN:i:``.  The
    first written direction of a link counts.  P names are read once the bp of
    their steps are known.
    """
    rows = lines.select("pos", F.split("line", "\t").alias("c")).select("pos", "c", F.col("c")[0].alias("kind"))
    c = lambda k: F.get(F.col("c"), k - 1)
    s = rows.where("kind = 'S'")
    stated = F.when(c(3) == "*", strict_number(_tag(F.col("c"), "LN:i:", 4))).otherwise(F.octet_length(c(3)).cast("bigint"))
    segments = s.select(
        c(2).alias("node"), stated.alias("length"), _tag(F.col("c"), "SN:Z:", 4).alias("sn"), strict_number(_tag(F.col("c"), "SO:i:", 4)).alias("so"),
        _tag(F.col("c"), "SR:i:", 4).try_cast("bigint").alias("sr"), F.when(c(3) != "*", c(3)).alias("bases"), F.col("pos").alias("ord"),
    )
    l = rows.where("kind = 'L'").select(
        "pos", c(2).alias("src"), (c(3) == "-").alias("src_rev"), c(4).alias("tgt"), (c(5) == "-").alias("tgt_rev"), F.coalesce(c(6), F.lit("*")).alias("overlap"), c(3).alias("s1"), c(5).alias("s2")
    )
    p = rows.where("kind = 'P'").select("pos", c(2).alias("written"), c(3).alias("text"), F.filter(F.split(c(3), ","), lambda x: x != "").alias("walk"), F.coalesce(c(4), F.lit("*")).alias("overlaps"))
    w = rows.where("kind = 'W'").select(
        "pos", F.concat_ws("#", c(2), c(3), c(4)).alias("written"), strict_number(c(5)).alias("start"), c(5).alias("start_text"), c(7).alias("text"),
        F.regexp_extract_all(c(7), F.lit("[<>][^<>]+"), 0).alias("walk"),
    )
    if check:
        blunt = lambda x: x.isin("", "*", "0M")
        _refuse(l.where(~F.col("s1").isin("+", "-") | ~F.col("s2").isin("+", "-") | F.col("s1").isNull() | F.col("s2").isNull()), lambda r: f"a link without a strand, at byte {r.pos}")
        _refuse(l.where(~blunt(F.col("overlap"))), lambda r: f"the link at byte {r.pos} overlaps by {r.overlap}; coordinates need ends that abut")
        _refuse(p.where(F.col("text").isNull()), lambda r: f"the P line at byte {r.pos} ends before its steps")
        _refuse(p.where(F.contains("text", F.lit(";"))), lambda r: f"{r.written} jumps with a ;, over a distance that no line tells")
        _refuse(p.where(F.exists("walk", lambda x: ~x.rlike("^.+[+-]$"))), lambda r: f"{r.written} has a step without a strand")
        _refuse(p.where(F.exists(F.split("overlaps", ","), lambda x: ~blunt(x))), lambda r: f"{r.written} overlaps by {r.overlaps}; coordinates need ends that abut")
        _refuse(w.where(F.col("text").isNull()), lambda r: f"the W line at byte {r.pos} ends before its walk")
        _refuse(w.where(F.col("start").isNull()), lambda r: f"the W line at byte {r.pos} starts at {r.start_text}, not at a number")
        # What a walk may not have, sought place by place: a pattern of the whole walk recurses once a step.
        _refuse(w.where((F.col("text") != "*") & F.col("text").rlike(r"^[^<>]|[<>](?:[<>]|\z)|\s")), lambda r: f"the walk of {r.written} holds more than steps")
    key = F.least(
        F.struct(F.col("src").alias("a"), F.col("src_rev").alias("b"), F.col("tgt").alias("c"), F.col("tgt_rev").alias("d")),
        F.struct(F.col("tgt").alias("a"), (~F.col("tgt_rev")).alias("b"), F.col("src").alias("c"), (~F.col("src_rev")).alias("d")),
    )
    first = l.groupBy(key.alias("k")).agg(F.min(F.struct("pos", "src", "src_rev", "tgt", "tgt_rev")).alias("l"))
    links = first.select(F.col("l.pos").alias("link"), "l.src", "l.src_rev", "l.tgt", "l.tgt_rev")
    line = F.col("pos").cast("string").alias("line")
    p_steps = p.select(line, F.posexplode("walk").alias("i", "step")).select(
        "line", F.col("i").cast("bigint").alias("i"), F.expr("left(step, length(step) - 1)").alias("node"), (F.expr("right(step, 1)") == "-").alias("rev")
    )
    w_steps = w.select(line, F.posexplode("walk").alias("i", "step")).select(
        "line", F.col("i").cast("bigint").alias("i"), F.expr("substring(step, 2)").alias("node"), F.startswith("step", F.lit("<")).alias("rev")
    )
    bp = p_steps.join(segments.select("node", "length"), "node").groupBy("line").agg(F.sum("length").alias("bp"))
    named = p.select(line, "pos", "written").join(bp, "line", "left").withColumn("n", path_name(F.col("written"), F.coalesce("bp", F.lit(0)).cast("decimal(20,0)")))
    if check:
        _refuse(named.where("n.error is not null"), lambda r: f"{r.written}: {r.n.error}")
    p_lines = named.select("line", F.col("n.path").alias("name"), "written", F.col("n.start").alias("start"), F.col("pos").alias("ord"))
    w_lines = w.select(line, F.col("written").alias("name"), "written", "start", F.col("pos").alias("ord"))
    return Graph(segments, links, p_lines.unionByName(w_lines), p_steps.unionByName(w_steps))


#: Fixed value: the greatest coordinate of a walk file, exact in a double.
MOST = 1 << 53


def check_walks(lines: DataFrame, graph: Graph) -> None:
    """Refuse what walk files cannot state, beyond what ``parse_gfa`` refuses.

    Names of other than printable ASCII without blanks, or that begin with
    ``#``; a ``#`` in a W line's sample or haplotype; a W line whose end is not
    where its steps end; starts past 2^53; ids of 2^31 and more or that are no
    numbers; segments told twice.
    """
    c = lambda k: F.get(F.split("line", "\t"), k - 1)
    w = lines.where(F.startswith("line", F.lit("W\t"))).select(F.col("pos").cast("string").alias("line"), c(2).alias("a"), c(3).alias("b"), c(6).alias("end_text"), strict_number(c(6)).alias("end"))
    _refuse(w.where(F.contains("a", F.lit("#")) | F.contains("b", F.lit("#"))), lambda r: f"{r.a} or {r.b}: a # parts the fields of a name and cannot be in one")
    _refuse(w.where(F.col("end").isNull()), lambda r: f"the W line at byte {r.line} ends at {r.end_text}, not at a number")
    _refuse(graph.lines.where(~F.col("name").rlike('^[!"$-~][!-~]*$')), lambda r: f"{r.name!r} is no name that a walk file can hold")
    _refuse(graph.lines.where(F.col("start") > MOST), lambda r: f"{r.name} begins at {r.start}, beyond 2^53")
    _refuse(graph.segments.groupBy("node").count().where("count > 1"), lambda r: f"segment {r.node} is told {r['count']} times")
    _refuse(graph.segments.where(~F.col("node").rlike("^[0-9]{1,10}$") | (F.col("node").try_cast("bigint") >= 1 << 31)), lambda r: f"{r.node} is no id below 2^31")
    bp = graph.steps.join(graph.segments.select("node", "length"), "node").groupBy("line").agg(F.sum("length").alias("bp"))
    ends = w.join(graph.lines, "line").join(bp, "line", "left").withColumn("reached", F.col("start") + F.coalesce("bp", F.lit(0)))
    _refuse(ends.where("`end` <> reached"), lambda r: f"the steps of {r.name} end at {r.reached}, not at {r.end}")


def _refuse(rows: DataFrame, message) -> None:
    found = rows.limit(1).collect()
    if found:
        raise Refusal(message(found[0]))


def read_gfa(spark: SparkSession, path: str, check: bool = True) -> Graph:
    """A graph file, or a folder of its parts; read once, and kept in the shared folder for the several kinds of lines."""
    return parse_gfa(written(read_lines(spark, path), "gfa-lines"), check)


def read_walks(spark: SparkSession, path: str) -> Graph:
    """A graph file for walks: ``read_gfa`` with the stricter refusals."""
    lines = written(read_lines(spark, path), "gfa-lines")
    graph = parse_gfa(lines)
    check_walks(lines, graph)
    return graph


def gfa_of_text(spark: SparkSession, text: str, walks: bool = False) -> Graph:
    """A graph of a small text, for tests."""
    rows, at = [], 0
    for line in text.splitlines():
        rows.append((at, line))
        at += len(line) + 1
    lines = spark.createDataFrame(rows, "pos bigint, line string")
    graph = parse_gfa(lines)
    if walks:
        check_walks(lines, graph)
    return graph


def gfa_text(graph: Graph) -> DataFrame:
    """``(kind_rank, key, line)``: a graph as GFA lines, paths as W lines where their name has three fields, else as P lines."""
    t = lambda *cols: F.concat_ws("\t", *[c if not isinstance(c, str) else F.col(c).cast("string") for c in cols])
    sign = lambda c: F.when(F.col(c), "-").otherwise("+")
    row = lambda df, rank, key, line: df.select(F.lit(rank).alias("kind_rank"), F.col(key).cast("string").alias("key"), line.alias("line"))
    s = row(graph.segments, 0, "node", t(F.lit("S"), "node", F.lit("*"), F.concat(F.lit("LN:i:"), F.col("length").cast("string"))))
    l = row(graph.links, 1, "src", t(F.lit("L"), "src", sign("src_rev"), "tgt", sign("tgt_rev"), F.lit("0M")))
    steps = graph.steps.join(graph.segments.select("node", "length"), "node").groupBy("line").agg(
        F.array_sort(F.collect_list(F.struct("i", F.col("node").cast("string").alias("n"), "rev"))).alias("s"), F.sum("length").alias("bp")
    )
    lines = graph.lines.select("line", "name", "start").join(steps, "line").withColumn("f", F.split("name", "#"))
    walk = F.array_join(F.transform("s", lambda x: F.concat(F.when(x["rev"], "<").otherwise(">"), x["n"])), "")
    path = F.array_join(F.transform("s", lambda x: F.concat(x["n"], F.when(x["rev"], "-").otherwise("+"))), ",")
    f = lambda k: F.get("f", F.lit(k))
    w = t(F.lit("W"), f(0), f(1), F.array_join(F.slice("f", 3, F.size("f")), "#"), "start", (F.col("start") + F.col("bp")).cast("string"), walk)
    p = t(F.lit("P"), F.when(F.col("start") > 0, F.concat("name", F.lit("["), F.col("start").cast("string"), F.lit("]"))).otherwise(F.col("name")), path, F.lit("*"))
    return s.unionByName(l).unionByName(row(lines, 2, "line", F.when(F.size("f") >= 3, w).otherwise(p)))
