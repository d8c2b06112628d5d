"""Large source files read by more tasks than one: records that go over many lines, cut where they begin, also over the borders of splits.

Spark deals the lines of a file over tasks by byte ranges.  Each task cuts the lines of its range into
records; what stands before its first cut goes on a record of a range before it, and its last record may
go on in the next one.  Only these edges, two of a range, are shuffled, put together in the order of
the file and cut again.  Whole records never leave their task.

- HL7: a record is the messages of one patient that follow each other, as in a file of one patient: it begins
  at a message that names another patient (PID-3) than the one before; messages without a patient go on.
- Flat extracts: a record ends with its line, unless the line ends inside a quoted cell.  Whether a range
  begins inside one depends on all ranges before it: a first pass tells, for either beginning, how each
  range ends, and a fold over a file's ranges settles which it is.  A quote that is never closed takes
  the rest of its file into the record.

Empty files give no records.  Lines before a file's first patient are a record of their own, without a
patient.  Compressed files can't be split, and are one range.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vitalspark.sources import files

#: line: the first byte of a range and the lines before the record in it: grows through a file, as no line is without a byte.
RECORD = "name string, line long, edge boolean, opens boolean, lines array<string>"


def _lines(spark: SparkSession, path: str, sep: str | None) -> DataFrame:
    """name (of the file), block (first byte of the range), value of each line, in order within a range."""
    read = spark.read.option("recursiveFileLookup", "true")
    rows = (read if sep is None else read.option("lineSep", sep)).text(path)
    return rows.select(F.col("_metadata.file_path").alias("name"), F.col("_metadata.file_block_start").alias("block"), "value")


class Cutter(Protocol):
    """Cuts lines into records; `inside`: whether the lines begin inside a record."""

    def __init__(self, inside: bool): ...

    def feed(self, line: str) -> list[str] | None:
        """The lines of the record that ends before or with this line, if one does."""

    def rest(self) -> list[str]:
        """Lines of the record that is still open."""


class MessageCutter:
    """A record begins at a message that names another patient than the record before it.

    Lines that begin inside a record may be of its patient: their first patient makes no cut, and it is for whoever
    puts them together with the lines before to tell.
    """

    def __init__(self, inside: bool = True):
        self.inside, self.patient = inside, None
        self.record: list[str] = []
        self.pending: list[str] = []

    def feed(self, line: str) -> list[str] | None:
        if not line.strip():
            return None
        if line.startswith("MSH|"):
            self.record += self.pending
            self.pending = [line]
            return None
        if not self.pending:
            self.record.append(line)
            return None
        self.pending.append(line)
        patient = line.split("|")[3].strip() if line.startswith("PID|") and line.count("|") > 2 else ""
        if not patient:
            return None
        before, self.patient = self.patient, patient
        if before == patient or (before is None and (self.inside or not self.record)):
            self.record += self.pending
            self.pending = []
            return None
        done, self.record, self.pending = self.record, self.pending, []
        return done

    def rest(self) -> list[str]:
        return self.record + self.pending


#: A cell of a line that begins outside quotes: quoted and closed, quoted and open at the line's end, or plain.
_CELL = re.compile(r'"(?:[^"]|"")*("?)[^,]*(?:,|$)|[^,]*(?:,|$)')
_CLOSE = re.compile(r'(?:[^"]|"")*("?)[^,]*(?:,|$)')


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a line ends inside a quoted cell."""
    if '"' not in line:
        return inside
    at = 0
    if inside:
        met = _CLOSE.match(line)
        if not met[1]:
            return True
        at = met.end()
    while at < len(line):
        met = _CELL.match(line, at)
        if line[at] == '"' and not met[1]:
            return True
        at = met.end()
    return False


class ExtractCutter:
    """A record ends with a line that ends outside quotes."""

    def __init__(self, inside: bool = False):
        self.inside, self.record = inside, []

    def feed(self, line: str) -> list[str] | None:
        self.record.append(line)
        self.inside = ends_inside(line, self.inside)
        if self.inside:
            return None
        done, self.record = self.record, []
        return done

    def rest(self) -> list[str]:
        return self.record


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], bool, list[str]]]:
    """((name, block), whether it is new, lines) of runs of lines of one range."""
    now = None
    for batch in batches:
        names, blocks, values = batch.column(0), batch.column(1), batch.column(2)
        at = 0
        while at < len(batch):
            key = (names[at].as_py(), blocks[at].as_py())
            same = pc.and_(pc.equal(names.slice(at), key[0]), pc.equal(blocks.slice(at), key[1]))
            end = pc.index(same, False).as_py()
            end = len(batch) if end < 0 else at + end
            yield key, key != now, values.slice(at, end - at).to_pylist()
            now, at = key, end


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 5
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.list_(pa.string())), strict=True)], names=[x.split()[0] for x in RECORD.split(", ")])


def _cut(lines: DataFrame, cutter: Callable[[bool], Cutter], inside: dict[tuple[str, int], bool], default: bool) -> DataFrame:
    """RECORD rows of each range.  A range's first record is an edge if it begins inside one, its last if it isn't ended; opens: whether the edge is a record's beginning."""
    sent = lines.sparkSession.sparkContext.broadcast(inside)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, cut, fed, begin, continues = None, None, 0, 0, False  # lines given to the cutter, and before the record that is open

        def last() -> list[tuple]:
            rest = cut.rest() if cut is not None else []
            return [(key[0], key[1] + begin, True, not continues, rest)] if rest else []

        for at, new, values in _ranges(batches):
            out = []
            if new:
                out += last()
                continues = sent.value.get(at, default)
                key, cut, fed, begin = at, cutter(continues), 0, 0
            for line in values:
                done, fed = cut.feed(line), fed + 1
                if done is not None:
                    if done:
                        out.append((key[0], key[1] + begin, continues, not continues, done))
                    begin, continues = fed - len(cut.rest()), False
            if out:
                yield _rows(out)
        yield _rows(last())

    return lines.mapInArrow(run, RECORD)


def _joined(cut: DataFrame, cutter: Callable[[bool], Cutter]) -> DataFrame:
    """(name, line, lines) of all records: whole ones as they are, edges put together in the order of the file and cut again."""
    order = Window.partitionBy("name").orderBy("line")
    edges = cut.where("edge").withColumn("record", F.sum(F.col("opens").cast("long")).over(order))
    grouped = edges.groupBy("name", "record").agg(F.array_sort(F.collect_list(F.struct("line", "lines"))).alias("parts"))
    grouped = grouped.select("name", F.col("parts")[0]["line"].alias("line"), F.flatten(F.transform("parts", lambda x: x["lines"])).alias("lines"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, line, lines in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                again = cutter(False)
                found = [x for x in (*map(again.feed, lines), again.rest()) if x]
                begins = itertools.accumulate(map(len, found[:-1]), initial=0)
                out += [(name, line + i, False, True, x) for i, x in zip(begins, found, strict=True)]
            yield _rows(out)

    return cut.where("NOT edge").unionByName(grouped.mapInArrow(run, RECORD)).select("name", "line", "lines")


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """name, text, format ('hl7v2') of the records of files of HL7 messages: what files.read() gives for a file of one record each."""
    lines = _lines(spark, path, None)
    found = _joined(_cut(lines, MessageCutter, {}, True), MessageCutter)
    return found.select(F.concat_ws("#", "name", F.col("line").cast("string")).alias("name"), F.array_join("lines", "\r").alias("text"), F.lit("hl7v2").alias("format"))


ENDS = "name string, block long, outside boolean, inside boolean"


def _begins_inside(lines: DataFrame) -> dict[tuple[str, int], bool]:
    """The ranges that begin inside a quoted cell: never more than the ranges that the driver deals out itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends: dict[tuple[str, int], list[bool]] = {}
        for key, _, values in _ranges(batches):
            state = ends.setdefault(key, [False, True])
            for line in values:
                if '"' in line:
                    state[0], state[1] = ends_inside(line, state[0]), ends_inside(line, state[1])
        rows = [(*k, *v) for k, v in ends.items()]
        columns = list(zip(*rows, strict=True)) if rows else [()] * 4
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.bool_(), pa.bool_()), strict=True)], names=["name", "block", "outside", "inside"])

    ends = lines.mapInArrow(run, ENDS).groupBy("name").agg(F.array_sort(F.collect_list(F.struct("block", "outside", "inside"))).alias("ranges"))
    # A fold over a file's ranges: state is how the range before ended.
    start = F.struct(F.lit(False).alias("now"), F.array().cast("array<bigint>").alias("blocks"))
    step = lambda s, x: F.struct(F.when(s["now"], x["inside"]).otherwise(x["outside"]).alias("now"), F.when(s["now"], F.array_append(s["blocks"], x["block"])).otherwise(s["blocks"]).alias("blocks"))
    found = ends.select("name", F.explode(F.aggregate("ranges", start, step, lambda s: s["blocks"])).alias("block"))
    return {(r["name"], r["block"]): True for r in found.toLocalIterator()}


def read_extract_lines(spark: SparkSession, path: str) -> DataFrame:
    """name, line (a number that grows through the file), text of the records of flat extracts."""
    lines = _lines(spark, path, "\n")
    found = _joined(_cut(lines, ExtractCutter, _begins_inside(lines), False), ExtractCutter)
    return found.select("name", "line", F.regexp_replace(F.array_join("lines", "\n"), r"\r$", "").alias("text")).where(F.trim("text") != "")


def read_extract_rows(spark: SparkSession, path: str) -> DataFrame:
    """name, line, row (map of lower-case header to trimmed value), as files.csv_rows() gives them, of flat extracts of any size."""
    lines = read_extract_lines(spark, path)
    first = lines.groupBy("name").agg(F.min_by("text", "line").alias("text"), F.min("line").alias("line"))
    heads = first.select("name", F.col("line").alias("first"), F.transform(files.csv_cells(F.regexp_replace("text", "^\ufeff", "")), F.lower).alias("head"))
    body = lines.withColumn("cells", files.csv_cells(F.col("text"))).join(F.broadcast(heads) if heads.count() <= files.FEW_FILES else heads, "name").where("line > first")
    return body.select("name", "line", F.map_from_entries(F.filter(F.arrays_zip("head", "cells"), lambda x: x["head"].isNotNull())).alias("row"))
