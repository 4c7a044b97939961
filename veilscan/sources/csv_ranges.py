"""CSV files with line ends inside quoted fields, read by many tasks.

Spark cuts a text file into byte ranges and gives each range the lines that begin in it, but whether a line begins inside a quoted field
depends on all the text before. So each range first tells, in one pass over its lines, in which state it ends for either state that it may
begin in. These maps are composed in the order of the ranges (one small row per range), which gives the state that each range begins in. Then
every range parses the records that begin and end in it; the pieces of a record that crosses borders, however many, are brought together
by the range that the record begins in.

The state follows fields, not just the number of quotes: a quote opens a field only where the field begins, two quotes inside are one, and
after the closing quote all is plain up to the next comma.

* Fields are text: null where empty, quoted or not, or missing. Empty lines are no records. Bad bytes become U+FFFD. Blanks behind
  a closing quote are dropped; with other text there the field is taken as it stands. This is what Spark's own reader does.
* The first record of each file is its header; names are those of the first file. In a record that ends with CR LF, inner ones become LF.
* A quoted field that is never closed reaches to the end of its file.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

_INSIDE = re.compile(rb'[^"]*(?:""[^"]*)*')
Place = tuple[str, int]


def inside_after(line: bytes, inside: bool) -> bool:
    """Whether the text behind a line is inside a quoted field, if the line begins so."""
    if b'"' not in line:
        return inside
    at = 0
    while True:
        if not inside and line.startswith(b'"', at):
            inside, at = True, at + 1
        if inside:
            at = _INSIDE.match(line, at).end()
            if at == len(line):
                return True
        comma = line.find(b",", at)
        if comma < 0:
            return False
        at, inside = comma + 1, False


def fields(record: bytes, width: int) -> list[str | None]:
    """The first ``width`` fields of a record."""
    if record.endswith(b"\r"):
        record = record[:-1].replace(b"\r\n", b"\n")
    found, at = [], 0
    while at >= 0 and len(found) < width:
        opened = record.startswith(b'"', at)
        end = _INSIDE.match(record, at + 1).end() if opened else at
        comma = record.find(b",", end)
        stop = len(record) if comma < 0 else comma
        closed = opened and not record[end + 1 : stop].strip(b" \t")
        value = record[at + 1 : end].replace(b'""', b'"') if closed else record[at:stop]
        found.append(value.decode("utf-8", "replace") or None)
        at = comma + 1 if comma >= 0 else -1
    return found + [None] * (width - len(found))


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Place, Iterator[list[bytes]]]]:
    """Ranges in the order of a task's rows, each with its lines in lists."""
    parts = ((place, lines) for batch in batches for place, lines in _parts(batch))
    waiting = next(parts, None)

    def of(place: Place) -> Iterator[list[bytes]]:
        nonlocal waiting
        while waiting and waiting[0] == place:
            lines = waiting[1]
            waiting = next(parts, None)
            yield lines

    while waiting:
        place = waiting[0]
        rest = of(place)
        yield place, rest
        for _ in rest:  # what was not looked at
            pass


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[Place, list[bytes]]]:
    begins, paths = batch.column(2).to_numpy(), batch.column(1)
    low = 0
    while low < batch.num_rows:
        place = (paths[low].as_py(), int(begins[low]))
        high = batch.num_rows
        if begins[-1] != place[1] or paths[high - 1].as_py() != place[0]:
            high = next(k for k in range(low + 1, high + 1) if k == high or begins[k] != place[1] or paths[k].as_py() != place[0])
        yield place, batch.column(0).slice(low, high - low).to_pylist()
        low = high


def _state_maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each range: how it ends from outside and from inside, and whether another record begins in it then."""
    rows = []
    for (path, begin), lists in _ranges(batches):
        states, again = [False, True], [False, False]
        for k, line in enumerate(line for lines in lists for line in lines):
            if k and not all(states):
                again = [a or not s for a, s in zip(again, states, strict=True)]
            if b'"' in line:
                states = [inside_after(line, s) for s in states]
        rows.append((path, begin, *states, *again))
    yield pa.RecordBatch.from_pylist([dict(zip(_MAP_NAMES, r, strict=True)) for r in rows], _MAP_SCHEMA)


_MAP_NAMES = ("path", "begin", "from_outside", "from_inside", "again_outside", "again_inside")
_MAP_SCHEMA = pa.schema([("path", pa.string()), ("begin", pa.int64()), *[(n, pa.bool_()) for n in _MAP_NAMES[2:]]])
_START = "path string, begin long, inside boolean, owner long, first boolean"


def _composed(maps: pd.DataFrame) -> pd.DataFrame:
    """The state at the start of each range of a file, and the range that the record open there began in; -1 if it is the header."""
    out, inside, owner = [], False, None
    for k, m in enumerate(maps.sort_values("begin").itertuples()):
        out.append((m.path, m.begin, inside, owner if inside else m.begin, k == 0))
        if k == 0 and not m.again_outside:
            owner = -1
        elif not inside or m.again_inside:
            owner = m.begin
        inside = m.from_inside if inside else m.from_outside
    return pd.DataFrame(out, columns=["path", "begin", "inside", "owner", "first"])


def _cut(lists: Iterator[list[bytes]], inside: bool) -> Iterator[tuple[list[bytes], bool]]:
    """Records of a range as lists of lines, and whether they end in it; the first one began before if the range begins inside."""
    record: list[bytes] = []
    for line in (line for lines in lists for line in lines):
        record.append(line)
        inside = inside_after(line, inside)
        if not inside:
            yield record, True
            record = []
    if record:
        yield record, False


def _start_of(starts: dict[Place, tuple], place: Place) -> tuple:
    if place not in starts:
        raise RuntimeError(f"{place} was not among the ranges of the first pass: the file or its ranges changed in between")
    return starts[place]


def _batch(rows: list[list[str | None]], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.string())] * len(names), names)


#: Bytes of records that go out together.
_OUT_BYTES = 1 << 22


def _whole(starts: dict[Place, tuple], names: list[str]):
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for place, lists in _ranges(batches):
            inside, _, first = _start_of(starts, place)
            for k, (lines, ends) in enumerate(_cut(lists, inside)):
                record = b"\n".join(lines)
                if not ends or k == 0 and (inside or first) or record in (b"", b"\r"):
                    continue
                rows.append(fields(record, len(names)))
                size += len(record)
                if size >= _OUT_BYTES:
                    yield _batch(rows, names)
                    rows, size = [], 0
        yield _batch(rows, names)

    return parse


def _pieces(starts: dict[Place, tuple]):
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for place, lists in _ranges(batches):
            inside, owner, first = _start_of(starts, place)
            for k, (lines, ends) in enumerate(_cut(lists, inside)):
                begun_before = k == 0 and inside
                if ends and not begun_before or k == 0 and first or begun_before and owner < 0:
                    continue
                yield pa.RecordBatch.from_arrays(
                    [pa.array([place[0]]), pa.array([owner if begun_before else place[1]], pa.int64()), pa.array([place[1]], pa.int64()),
                     pa.array([b"\n".join(lines)], pa.binary())], ["path", "owner", "begin", "piece"])

    return parse


def _joined(names: list[str]):
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            records = (b"\n".join(p["piece"] for p in of) for of in batch.column(0).to_pylist())
            yield _batch([fields(r, len(names)) for r in records if r not in (b"", b"\r")], names)

    return parse


def read(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The records of CSV files with a header, all columns as text, in no order.

    The text is scanned three times: for the states, for whole records and for the pieces of the others. What goes through the driver is
    a row per range, of which there are as many as tasks."""
    names = spark.read.csv(path, header=True, multiLine=True, escape='"').columns
    lines = spark.read.text(path, lineSep="\n").select(
        F.col("value").cast("binary").alias("line"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("begin"))
    maps = lines.mapInArrow(_state_maps, "path string, begin long, " + ", ".join(f"{n} boolean" for n in _MAP_NAMES[2:]))
    starts = {(r.path, r.begin): (r.inside, r.owner, r.first) for r in maps.groupBy("path").applyInPandas(_composed, _START).collect()}
    columns = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    whole = lines.mapInArrow(_whole(starts, names), columns)
    pieces = lines.mapInArrow(_pieces(starts), "path string, owner long, begin long, piece binary")
    of = pieces.groupBy("path", "owner").agg(F.array_sort(F.collect_list(F.struct("begin", "piece"))).alias("of")).select("of")
    return whole.unionByName(of.mapInArrow(_joined(names), columns))
