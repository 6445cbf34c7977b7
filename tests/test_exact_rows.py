"""Exact rows of files read in small byte ranges, against Python's csv module over the whole file."""

from __future__ import annotations

import csv
import random

import pytest

from ledgerlens.sources import exact as X

HEADER = "A_Party,B_Party,Date,Duration"


def read_plainly(text):
    """(number, first line, exact, cells) of the rows after the header that are not blank."""
    lines = [x for x in text.replace("\r\n", "\0").replace("\r", "\1\2").replace("\n", "\0\3").replace("\0\3", "\n\2").replace("\0", "\r\n\2").replace("\1", "\r").split("\2")]
    lines = [x for x in lines if x]
    reader, out, ended = csv.reader(lines), [], 0
    for cells in reader:
        began, ended = ended, reader.line_num
        if began and "".join(cells).strip():
            out.append((len(out) + 1, began + 1, "".join(lines[began:ended]).rstrip("\r\n"), [c.strip() for c in cells]))
    return out


def sheet(seed, rows, ends):
    rng = random.Random(seed)
    cells = ["98765", "", " x ", 'say ""hi""', '"quoted"', '"two\nlines"', '"a,b"', '"c""d\r\ne"', 'mid"dle', '"closed" then', "é日本", '"' + "long " * 40 + '\n"', '"tail\r"']
    out = [HEADER]
    for _ in range(rows):
        out.append("" if rng.random() < 0.1 else ",".join(rng.choice(cells) for _ in range(rng.randint(1, 5))))
    return "".join(x + rng.choice(ends) for x in out[:-1]) + out[-1]


@pytest.fixture
def small_ranges(spark):
    names = {"spark.sql.files.maxPartitionBytes": "97", "spark.sql.files.openCostInBytes": "1"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def test_rows_of_many_ranges_equal_the_csv_module(spark, tmp_path, small_ranges):
    texts = {"a": sheet(1, 60, ["\n"]), "b": sheet(2, 40, ["\n", "\r\n"]), "c": sheet(3, 25, ["\r\n", "\r", "\n"]), "d": "﻿" + HEADER + '\n1,2,"never closed\n3,4', "e": HEADER, "f": HEADER + "\n\n\n1,2,3\n"}
    for name, text in texts.items():
        (tmp_path / f"{name}.csv").write_bytes(text.encode())
    (tmp_path / "g.csv").write_bytes(b"")
    lines = X.raw_lines(spark, str(tmp_path))
    assert lines.select("path", "block").distinct().count() > 30
    found = {}
    for r in X.exact_rows(lines, "call_records").collect():
        found.setdefault(r.path[-5], []).append((r.number, r.first_line, r.exact, r.fields))
    for name, text in texts.items():
        want = read_plainly(text.removeprefix("﻿"))
        own = sorted(found.get(name, []), key=lambda x: x[0])
        assert [x[:3] for x in own] == [x[:3] for x in want], name
        assert [[x[3]["caller"], x[3]["callee"], x[3]["timestamp"]] for x in own] == [(x[3] + ["", "", ""])[:3] for x in want], name


@pytest.mark.parametrize("line", ['a,"b', 'a,"b""', 'a,"b"",c', '"a"b,"c', 'a"b,c', '"', '""', '"""', "", ',"', '"a","b"'])
@pytest.mark.parametrize("inside", [False, True])
def test_open_cells_are_those_of_the_csv_module(line, inside):
    """A further line is part of the row if, and only if, a cell is open."""
    lead = ['"open\n'] if inside else []
    rows = list(csv.reader([*lead, f"{line}\n", "next\n"]))
    assert X.inside_after(line, inside) == (len(rows) == 1)


def test_a_header_without_a_required_column_raises(spark, tmp_path):
    (tmp_path / "x.csv").write_text("A_Party,Other\n1,2\n")
    with pytest.raises(Exception, match="missing"):
        X.exact_rows(X.raw_lines(spark, str(tmp_path)), "call_records").collect()
