"""CSV files as numbered records, blank lines and damaged rows kept, in parallel whatever a file's size.

Files are read line by line in byte ranges, as Spark deals them out.  Whether a range
begins inside a quoted cell is not known when it is read, so:

1. a first pass tells for each range, under both guesses, whether it ends inside a quoted
   cell and how many records end in it;
2. these are strung together file by file, a row for each range: where each range really
   begins and how many records came before;
3. a second pass parses.  A record that crosses ranges leaves its lines as pieces, which
   meet by the record's number; all other records are done where they are read.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmerge.sources.scratch import materialise

#: Characters of a cell that many readers refuse to go beyond.
WIDE_CELL = 131_072
MARK = b"\xef\xbb\xbf"


def _ended(line: str, inside: bool) -> bool:
    """Whether a quoted cell is open at the end of the line."""
    if '"' not in line:
        return inside
    return list(csv.reader(['"' + line if inside else line, "."]))[-1] != ["."]


def _lines(parts: Iterator[pa.RecordBatch], *more: str) -> Iterator[tuple]:
    """(path, start of the range, line, whether bytes of it were no UTF-8, *more) of each line that a CSV reader sees.

    The byte-order mark is eaten; carriage returns end lines too.
    """
    csv.field_size_limit(2**31 - 1)
    before = None
    for part in parts:
        for path, start, line, *rest in zip(*[part.column(c).to_pylist() for c in ("path", "start", "line", *more)], strict=True):
            if (path, start) != before and start == 0 and line.startswith(MARK):
                line = line[len(MARK) :]
            before = (path, start)
            try:
                text, damaged = line.decode() + "\n", False
            except UnicodeDecodeError:
                text, damaged = line.decode("utf-8", "replace") + "\n", True
            for one in [text] if "\r" not in text[:-2] else io.StringIO(text, newline=""):
                yield path, start, one, damaged, *rest


def _guessed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, start, from_outside, n_outside, from_inside, n_inside) of each range."""
    out: list[list] = []
    for path, start, line, _ in _lines(parts):
        if not out or out[-1][:2] != [path, start]:
            out.append([path, start, False, 0, True, 0])
        row = out[-1]
        for at in (2, 4):
            row[at] = _ended(line, row[at])
            row[at + 1] += not row[at]
    if out:
        kinds = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["path", "start", "from_outside", "n_outside", "from_inside", "n_inside"])


def _strung(ranges: pd.DataFrame) -> pd.DataFrame:
    """One file's ranges in order: how each begins and ends, and the records before and up to its end."""
    inside, before, rows = False, 0, []
    for r in ranges.sort_values("start").itertuples():
        ends, n = (r.from_inside, r.n_inside) if inside else (r.from_outside, r.n_outside)
        rows.append((r.path, r.start, inside, bool(ends), before, before + n))
        inside, before = bool(ends), before + n
    return pd.DataFrame(rows, columns=["path", "start", "inside", "ends_inside", "before", "upto"])


def _fault(cells: list[str], damaged: bool) -> str | None:
    return "undecodable_bytes" if damaged else "oversized_cell" if any(len(c) > WIDE_CELL for c in cells) else None


def _cells(lines: list[str]) -> list[str]:
    if len(lines) == 1 and '"' not in lines[0] and "\r" not in lines[0]:
        return lines[0][:-1].split(",") if lines[0] != "\n" else []
    return next(csv.reader(lines))


RECORD = "path string, row_number long, cells array<string>, fault string, start long, piece string"


def _parsed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """RECORD rows of lines (path, start, line, inside, before): records, or their pieces where they cross ranges (cells null)."""
    held: list[tuple] = []
    here, inside, crossing, number, lines, hurt = None, False, False, 0, [], False

    def batch():
        kinds = [pa.string(), pa.int64(), pa.list_(pa.string()), pa.string(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names=["path", "row_number", "cells", "fault", "start", "piece"])

    def piece():
        held.append((here[0], number, None, "undecodable_bytes" if hurt else None, here[1], "".join(lines)))

    for path, start, line, damaged, begins_inside, before in _lines(parts, "inside", "before"):
        if (path, start) != here:
            if lines:
                piece()
            here, inside, crossing, number, lines, hurt = (path, start), begins_inside, begins_inside, before + 1, [], False
        lines.append(line)
        hurt = hurt or damaged
        inside = _ended(line, inside)
        if inside:
            continue
        if crossing:
            piece()
        else:
            cells = _cells(lines)
            held.append((path, number, cells, _fault(cells, hurt), start, None))
        crossing, number, lines, hurt = False, number + 1, [], False
        if len(held) >= 4096:
            yield batch()
            held = []
    if lines:
        piece()
    if held:
        yield batch()


def _put_together(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """RECORD rows of (path, row_number, pieces, damaged)."""
    csv.field_size_limit(2**31 - 1)
    for part in parts:
        out = []
        for path, number, pieces, damaged in zip(*[part.column(c).to_pylist() for c in ("path", "row_number", "pieces", "damaged")], strict=True):
            text = "".join(pieces)
            reader = list(csv.reader([*io.StringIO(text, newline=""), "."]))
            open_ = reader[-1] != ["."]
            cells = next(csv.reader(io.StringIO(text, newline="")))
            out.append((path, number, cells, "unterminated_quote" if open_ else _fault(cells, damaged), None, None))
        if out:
            kinds = [pa.string(), pa.int64(), pa.list_(pa.string()), pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["path", "row_number", "cells", "fault", "start", "piece"])


def scanned(spark: SparkSession, path: str) -> DataFrame:
    """(path, start, line binary) of every line, in order within a byte range, ranges of a file in any number of tasks."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("line"))


def ranges(spark: SparkSession, path: str) -> DataFrame:
    """(path, start, inside, ends_inside, before, upto): each byte range, how it begins and ends, and records ended before it and up to its end."""
    guessed = scanned(spark, path).mapInArrow(_guessed, "path string, start long, from_outside boolean, n_outside long, from_inside boolean, n_inside long")
    # the same range comes from one task; a group has a row for each range of a file
    return materialise(guessed.groupBy("path").applyInPandas(_strung, "path string, start long, inside boolean, ends_inside boolean, before long, upto long"), "csv-ranges")


def read_records(spark: SparkSession, path: str, across: bool = False) -> DataFrame:
    """(path, row_number, cells array<string>, fault) of every record, the header included as number 1.

    A record's number counts records, not lines: a quoted line break does not end one.
    With ``across`` numbers go on from file to file, in order of their names.  A blank
    line is a record without cells, a byte-order mark is eaten.  Nothing fails: bytes that
    are no UTF-8 come as U+FFFD, ``fault`` says so; it also tells of a cell over
    ``WIDE_CELL`` characters and of a quote that is never closed, which takes the rest of
    its file into one cell.  An empty file has no records.
    """
    known = ranges(spark, path)
    if across:
        files = known.groupBy("path").agg(F.max("upto").alias("upto"), F.max_by("ends_inside", "start").alias("open"))
        held = files.select("path", (F.col("upto") + F.col("open").cast("long")).alias("held"))
        earlier = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
        base = held.select("path", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("base"))
        known = known.join(base, "path").withColumn("before", F.col("before") + F.col("base"))
    # one row for each 128 MB or so of input
    lines = scanned(spark, path).join(F.broadcast(known.select("path", "start", "inside", "before")), ["path", "start"])
    parsed = lines.select("path", "start", "line", "inside", "before").mapInArrow(_parsed, RECORD)
    columns = ["path", "row_number", "cells", "fault"]
    if known.where("inside or ends_inside").isEmpty():
        return parsed.select(*columns)
    parsed = materialise(parsed, "csv-records")
    pieces = parsed.where("piece is not null").groupBy("path", "row_number")
    pieces = pieces.agg(F.transform(F.array_sort(F.collect_list(F.struct("start", "piece"))), lambda p: p["piece"]).alias("pieces"), F.max(F.col("fault").isNotNull()).alias("damaged"))
    whole = pieces.mapInArrow(_put_together, RECORD)
    return parsed.where("piece is null").unionByName(whole).select(*columns)


def csv_line(cells: Column) -> Column:
    """The cells as one line of CSV, each in quotes."""
    return F.array_join(F.transform(cells, lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))), ",")


def write_lines(rows: DataFrame, path: str, header: list[str], order: str) -> None:
    """Write (order, cells) as CSV part files in that order, whatever the width of a row; the header is the first file's first line."""
    first = rows.sparkSession.createDataFrame([(header,)], "cells array<string>")
    body = rows.select(F.col(order).cast("long").alias("at"), "cells").unionByName(first.select(F.lit(None).cast("long").alias("at"), "cells"))
    dealt = body.repartitionByRange(F.col("at").asc_nulls_first()).sortWithinPartitions(F.col("at").asc_nulls_first())
    dealt.select(csv_line(F.col("cells"))).write.text(path)


def by_header(header: list[str], cells: Column) -> Column:
    """A record's cells under their header, padded or cut to its width."""
    wide = F.slice(F.concat(cells, F.array_repeat(F.lit(""), len(header))), 1, len(header))
    return F.map_from_arrays(F.array(*[F.lit(h) for h in header]), wide)
