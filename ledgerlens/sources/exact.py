"""Rows of CSV files exactly as they stand, read in byte ranges of any size.

Whether a line begins inside a quoted cell depends on all quotes before it.  Each
range is read once for both answers: what it makes of a beginning outside a cell
and of one inside.  These few bits compose over the ranges of a file, and with them
every range finds its own rows; only a row that crosses into the next range is put
together from its parts.  Row and line numbers are sums over the ranges before.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .records import check_required, resolve_headers
from .storage import stored

LINES = "path string, block long, line string"
#: A row's part in one range: complete, or to be joined with parts of other ranges.
_PARTS = "path string, start_block long, start_line long, block long, text string"


def raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, block, line) of text files; block is where the line's byte range begins, lines of a range are in order and end at line feeds."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))


def inside_after(line: str, inside: bool) -> bool:
    """Whether a quoted cell is open after a line that began outside or inside one.

    A quote opens a cell only as its first character; inside, two quotes are one
    character, and what follows a closing quote up to the comma is plain.
    """
    if '"' not in line:
        return inside
    at = 0
    while True:
        if not inside:
            # The next cell that begins with a quote.
            while not line.startswith('"', at):
                at = line.find(",", at) + 1
                if not at:
                    return False
            at, inside = at + 1, True
        while True:
            at = line.find('"', at)
            if at < 0:
                return True
            if not line.startswith('""', at):
                break
            at += 2
        inside = False
        at = line.find(",", at + 1) + 1
        if not at:
            return False


def _physical(line: str) -> list[str]:
    """The lines that carriage returns cut a line into, each with its own end but the last."""
    ended, body = line.endswith("\r"), line[:-1] if line.endswith("\r") else line
    parts = [f"{p}\r" for p in body.split("\r")]
    return [*parts[:-1], parts[-1] if ended else parts[-1][:-1]]


def _ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(path, block, lines, open0, open1): physical lines of each range and whether a cell is open after it, by how it began."""
    found: dict[tuple[str, int], list] = {}
    for batch in batches:
        for (path, block), lines in batch.groupby(["path", "block"], sort=False)["line"]:
            n, closed, opened = found.get((path, block), (0, False, True))
            for line in lines:
                for part in _physical(line):
                    n, closed, opened = n + 1, inside_after(part, closed), inside_after(part, opened)
            found[path, block] = [n, closed, opened]
    yield pd.DataFrame([(*k, *v) for k, v in found.items()], columns=["path", "block", "lines", "open0", "open1"])


def _parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of _PARTS; start_line counts physical lines of the file from 1, and is null where a row began in an earlier range."""
    state: dict[tuple[str, int], list] = {}

    def rows(batch: pd.DataFrame) -> Iterator[tuple]:
        for (path, block), own in batch.groupby(["path", "block"], sort=False):
            if (path, block) not in state:
                first = own.iloc[0]
                state[path, block] = [int(first["before"]), bool(first["began"]), None, []]
            number, inside, start, held = state[path, block]
            for line in own["line"]:
                pieces = _physical(line)
                for i, piece in enumerate(pieces):
                    number += 1
                    if not inside:
                        start, held = number, []
                    inside = inside_after(piece, inside)
                    held.append(piece if i < len(pieces) - 1 else f"{piece}\n")
                    if not inside:
                        yield path, block, start, block, "".join(held)
                        held = []
            state[path, block] = [number, inside, start, held]

    columns = ["path", "start_block", "start_line", "block", "text"]
    for batch in batches:
        yield pd.DataFrame(list(rows(batch)), columns=columns).astype({"start_line": "Int64"})
    # Rows that the range leaves open.
    rest = [(path, block, start, block, "".join(held)) for (path, block), (_, _, start, held) in state.items() if held]
    yield pd.DataFrame(rest, columns=columns).astype({"start_line": "Int64"})


def _cells(text: str) -> list[str]:
    return next(csv.reader(io.StringIO(text, newline="")), [])


def exact_rows(lines: DataFrame, record: str) -> DataFrame:
    """(path, number, first_line, exact, fields) of the data rows of CSV files, from their lines (path, block, line).

    number counts rows that are not blank from 1 after the header, first_line is the
    physical line that a row begins at, exact its text without the line's end (several
    lines where a cell is quoted over them), fields its cells by canonical name,
    trimmed.  A quoted cell that is never closed reaches to the end of the file.  A
    file whose header lacks a required column raises; an empty file has no rows.
    """
    ranges = stored(lines.mapInPandas(_ranges, "path string, block long, lines long, open0 boolean, open1 boolean"), "exact-ranges")
    order = Window.partitionBy("path").orderBy("block")  # the ranges of a file, a row each
    ahead = order.rowsBetween(Window.unboundedPreceding, -1)
    # A range that ends alike either way settles the state, one that ends unlike its beginning turns it, others leave it.
    turned = ranges.withColumn("turns", F.sum((F.col("open0") & ~F.col("open1")).cast("int")).over(order))
    settled = turned.withColumn("settled", F.when(F.col("open0") == F.col("open1"), F.struct("open0", "turns")))
    known = settled.withColumns({"known": F.last("settled", ignorenulls=True).over(ahead), "turns": F.coalesce(F.lag("turns").over(order), F.lit(0))})
    odd = (F.col("turns") - F.coalesce("known.turns", F.lit(0))) % 2 == 1
    began = F.coalesce("known.open0", F.lit(False)) != odd
    before = F.coalesce(F.sum("lines").over(ahead), F.lit(0).cast("long"))
    placed = stored(known.select("path", "block", began.alias("began"), before.alias("before")), "exact-placed")
    # One row a range of many megabytes: small enough for every task, so that lines keep their order and are not shuffled.
    told = lines.join(F.broadcast(placed.select("path", "block", "began", "before")), ["path", "block"])
    parts = stored(told.select("path", "block", "line", "began", "before").mapInPandas(_parts, _PARTS), "exact-parts")

    # A part without a start goes on with the last row that began in a range before.
    whole = parts.where("start_line is not null")
    opened = whole.groupBy("path", "block").agg(F.max("start_line").alias("last"))
    since = F.last("last", ignorenulls=True).over(ahead)
    owner = placed.join(opened, ["path", "block"], "left").select("path", "block", since.alias("owner"))
    goes_on = parts.where("start_line is null").drop("start_line").join(owner, ["path", "block"]).withColumn("start_line", F.col("owner"))
    more = goes_on.groupBy("path", "start_line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda p: p.text), "").alias("more"))
    joined = whole.join(more, ["path", "start_line"], "left").select("path", F.col("block"), "start_line", F.concat("text", F.coalesce("more", F.lit(""))).alias("text"))

    bom = F.regexp_replace("text", "^﻿", "")
    header = joined.where("start_line = 1").select("path", bom.alias("header"))
    rows = joined.where("start_line > 1").join(header, "path")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, dict[str, int]] = {}
        for batch in batches:
            out = []
            for path, block, start, text, header in batch[["path", "block", "start_line", "text", "header"]].itertuples(index=False):
                cells = _cells(text)
                if not "".join(cells).strip():
                    continue
                if header not in known:
                    names = _cells(header)
                    headers = resolve_headers(names, record, exclusive=True)
                    check_required(headers, record, names)
                    known[header] = {name: names.index(column) for name, column in headers.items()}
                fields = {name: cells[i].strip() if i < len(cells) else "" for name, i in known[header].items()}
                out.append((path, block, start, text.rstrip("\r\n"), fields))
            yield pd.DataFrame(out, columns=["path", "block", "first_line", "exact", "fields"])

    found = stored(rows.mapInPandas(read, "path string, block long, first_line long, exact string, fields map<string, string>"), "exact-rows")
    counts = placed.join(found.groupBy("path", "block").agg(F.count("*").alias("n")), ["path", "block"], "left")
    skipped = counts.select("path", "block", F.coalesce(F.sum("n").over(ahead), F.lit(0).cast("long")).alias("skipped"))
    number = F.row_number().over(Window.partitionBy("path", "block").orderBy("first_line"))  # of one range
    return found.withColumn("own", number).join(skipped, ["path", "block"]).select("path", (F.col("own") + F.col("skipped")).alias("number"), "first_line", "exact", "fields")
