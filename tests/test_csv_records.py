"""CSV in byte ranges against one reader over the whole file."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from quillmerge.sources.csv_records import csv_line, read_records
from quillmerge.sources.files import read_source


@pytest.fixture
def small_ranges(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "900", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def found(spark, path, **how):
    rows = read_records(spark, str(path), **how).collect()
    return [(r.row_number, list(r.cells)) for r in sorted(rows, key=lambda r: (r.path, r.row_number))]


def whole(data):
    return list(enumerate(csv.reader(io.StringIO(data.decode("utf-8-sig"), newline="")), 1))


def drawn(seed):
    r = random.Random(seed)
    cells = ["", "plain", "two words", 'a"b', "ünï", "x" * 150, '"quoted"', '"with, comma"', '"two\nlines"', '"a ""b"" c"', '"\n\n"', '"x"y', '"crlf\r\nin"', '" long ' + "line\n" * 60 + '"']
    lines = [",".join(r.choice(cells) for _ in range(r.randint(1, 4))) + r.choice(["\n", "\n", "\r\n", "\r"] if seed % 2 else ["\n"]) for _ in range(40)]
    lines += ["\n", " \n", ",,\n"]
    r.shuffle(lines)
    return ("﻿" * (seed % 3 == 0) + "".join(lines)).encode()


@pytest.mark.parametrize("seed", [0, 1])
def test_ranges_give_what_one_reader_gives(small_ranges, tmp_path, seed):
    data = drawn(seed)
    (tmp_path / "a.csv").write_bytes(data)
    assert found(small_ranges, tmp_path / "a.csv") == whole(data)
    lines = small_ranges.read.text(str(tmp_path / "a.csv")).select(F.countDistinct("_metadata.file_block_start")).first()[0]
    assert lines > 4  # several ranges were at work


def test_files_are_numbered_on(small_ranges, tmp_path):
    parts = [drawn(4), b"", drawn(6)]
    for k, data in enumerate(parts):
        (tmp_path / f"p{k}.csv").write_bytes(data)
    want = [cells for data in parts for _, cells in whole(data)]
    assert found(small_ranges, tmp_path, across=True) == list(enumerate(want, 1))


def test_damaged_bytes_huge_cells_and_open_quotes(spark, tmp_path):
    data = b"a,b\n\xff\xfe,1\n" + b"x" * 140_000 + b",2\nfine,3\n\"open,4\nmore\n"
    (tmp_path / "a.csv").write_bytes(data)
    rows = sorted(read_records(spark, str(tmp_path / "a.csv")).collect(), key=lambda r: r.row_number)
    assert [(r.row_number, r.fault) for r in rows] == [(1, None), (2, "undecodable_bytes"), (3, "oversized_cell"), (4, None), (5, "unterminated_quote")]
    assert rows[1].cells == ["��", "1"] and len(rows[2].cells[0]) == 140_000 and rows[4].cells == ["open,4\nmore\n"]


def test_faults_become_issues_of_the_source(spark, tmp_path):
    head = "Name,Phone Number,City,Verified,Projects Completed\n"
    (tmp_path / "c.csv").write_bytes(head.encode() + b"Asha Rao,9876543210,Pune,Y,3\nRavi \xff Kumar,9876543211,Pune,Y,3\n" + b'"' + b"n" * 140_000 + b'",9876543212,Pune,Y,3\n')
    records, _ = read_source(spark, str(tmp_path), "contacts")
    told = {r.row_number: [p.category for p in r.problems] for r in records.collect()}
    assert "undecodable_bytes" not in told[2] and told[3][0] == "undecodable_bytes" and told[4][0] == "oversized_cell"


def test_records_are_counted_as_records(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('﻿Name,Note\r\n"Asha\nRao","x, y"\r\n\r\nBina\r\n'.encode())
    (tmp_path / "b.csv").write_text("Name,Note\n")
    got = sorted((r.path[-5:], r.row_number, r.cells) for r in read_records(spark, f"file://{tmp_path}/*.csv").collect())
    assert got == [("a.csv", 1, ["Name", "Note"]), ("a.csv", 2, ["Asha\nRao", "x, y"]), ("a.csv", 3, []), ("a.csv", 4, ["Bina"]), ("b.csv", 1, ["Name", "Note"])]


def test_empty_file(spark, tmp_path):
    (tmp_path / "e.csv").write_bytes(b"")
    assert found(spark, tmp_path / "e.csv") == []


def test_lines_are_quoted(spark):
    row = spark.createDataFrame([(["a", None, 'x"y', "1,2"],)], "c array<string>").select(csv_line(F.col("c"))).first()
    assert row[0] == '"a","","x""y","1,2"'
