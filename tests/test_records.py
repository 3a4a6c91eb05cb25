"""Records over line ends, read from many splits of one file, against Python's own reader."""

import csv
import io
import random

import pytest

from tabloom.operators.rows import with_file_order
from tabloom.sources import audits, records
from tabloom.sources.delimited import CORRUPT, read_delimited


@pytest.fixture
def splits_of(spark):
    """Sets the size of file splits, and back."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k) for k in keys}

    def small(size):
        for k in keys:
            spark.conf.set(k, str(size))

    yield small
    for k, v in before.items():
        spark.conf.set(k, v)


def made(rng, delimiter, end, n):
    """A file of n records of three cells, some with line ends, quotes and delimiters inside, some lines empty."""
    cells = ["", "x", "some words", f"a{delimiter}b", 'say "so"', "one\ntwo", "crlf\r\ninside", "\n", '"\n"', "tail\n", "é" * 9, "long " * 30, "n\n" * 40]
    out, rows = ["k" + delimiter + "v" + delimiter + '"w"' + end], []
    for i in range(n):
        row = [str(i), rng.choice(cells), rng.choice(cells)]
        rows.append(row)
        quote = lambda c: '"' + c.replace('"', '""') + '"' if set(c) & set(f'"\r\n{delimiter}') or rng.random() < 0.2 else c
        out.append(delimiter.join(map(quote, row)) + end)
        out += [end] * rng.choice([0, 0, 0, 2])
    return "".join(out), rows


@pytest.mark.parametrize("delimiter,end,size", [(",", "\n", 64), (",", "\r\n", 257), ("\t", "\n", 1000), (";", "\r\n", 37)])
def test_one_file_in_many_tasks(spark, tmp_path, splits_of, delimiter, end, size):
    text, rows = made(random.Random(size), delimiter, end, 250)
    assert [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=delimiter) if r][1:] == rows
    path = tmp_path / "one.csv"
    path.write_bytes(text.encode())
    splits_of(size)
    assert records.numbered_lines(spark, str(path)).rdd.getNumPartitions() > 8
    got = with_file_order(read_delimited(spark, str(path), delimiter, places=True)).orderBy("row_id").collect()
    assert [r.row_id for r in got] == list(range(len(rows)))
    assert [[c or "" for c in (r.k, r.v, r.w)] for r in got] == rows


def test_splits_joined_instead_of_sent(spark, tmp_path, splits_of):
    text, rows = made(random.Random(3), ",", "\n", 80)
    (tmp_path / "t.csv").write_bytes(text.encode())
    splits_of(100)
    sent, joined = ([r.value for r in records.spanning_records(spark, str(tmp_path), n).collect()] for n in (10**6, 0))
    assert sorted(sent) == sorted(joined) and len(sent) == len(rows)


def test_several_files_each_with_a_header(spark, tmp_path, splits_of):
    every, size = [], 90
    for k in range(5):
        text, rows = made(random.Random(k), ",", "\n", 30)
        every += rows
        (tmp_path / f"{k}.csv").write_bytes(("\n\n" if k == 2 else "").encode() + ("﻿" if k == 3 else "").encode() + text.encode())
    splits_of(size)
    got = with_file_order(read_delimited(spark, str(tmp_path), places=True), broadcast_blocks=0).orderBy("row_id").collect()
    assert [[c or "" for c in (r.k, r.v, r.w)] for r in got] == every


def test_quarantine_and_open_cells(spark, tmp_path, splits_of):
    (tmp_path / "t.csv").write_bytes(b'a,b\n"x\ny",1\n"only\none"\n2,3,"f\nour"\n"open\nat the end')
    splits_of(8)
    got = read_delimited(spark, str(tmp_path), malformed="quarantine", audit=False).collect()
    assert sorted(r[CORRUPT] or "" for r in got) == ["", '"only\none"', '"open\nat the end', '2,3,"f\nour"']
    assert audits.quoting_report(spark, str(tmp_path)).select("lines", "line", "spans").collect() == [(9, 9, True)]


def test_row_numbers_do_not_replace_a_column(spark, tmp_path):
    (tmp_path / "t.csv").write_text("row_id,v\n7,x\n")
    with pytest.raises(ValueError, match="row_id"):
        with_file_order(read_delimited(spark, str(tmp_path)))
    assert with_file_order(read_delimited(spark, str(tmp_path), places=True), "n").collect() == [("7", "x", 0)]


def test_headers_of_many_files_are_joined(spark, tmp_path, monkeypatch):
    from tabloom.sources import delimited

    monkeypatch.setattr(delimited, "LITERAL_FILES", 2)
    for k in range(4):
        (tmp_path / f"{k}.csv").write_text(f"a,b\n{k},x\n")
    frame = read_delimited(spark, str(tmp_path))
    assert [tuple(r) for r in with_file_order(frame).orderBy("row_id").collect()] == [(str(k), "x", k) for k in range(4)]
