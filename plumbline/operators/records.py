"""Problem 5: rows that fail to parse, set apart with the reason.

Record blocks are parsed in bulk by a columnar CSV reader and checked with
vectorised expressions. A block whose structure fails (quoting, number of
columns, number of records) is bisected until the bad records stand alone;
these, and the records whose values fail a check, are diagnosed one by one by a
strict parser. A record never passes by the fast path alone: its quoting, its
count of fields and each of its numbers have been checked against the same
rules that the strict parser applies.
"""

from __future__ import annotations

import io
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROKEN, COUNT, VALUE = "broken_quoting", "wrong_column_count", "invalid_value"
#: Records of a block; below LEAF records a failing block is diagnosed directly.
BLOCK, LEAF = 1024, 4


@dataclass(frozen=True)
class Layout:
    """Columns of a record: names in order, which are numbers, which of these
    may not be negative."""

    names: tuple[str, ...]
    numbers: tuple[str, ...]
    not_negative: tuple[str, ...] = ()


STATION_LINE = Layout(
    ("station_id", "longitude_deg", "latitude_deg", "east_mm_per_year", "north_mm_per_year", "up_mm_per_year", "sigma_east_mm_per_year", "sigma_north_mm_per_year", "sigma_up_mm_per_year", "quality", "duration_years", "remark"),
    ("longitude_deg", "latitude_deg", "east_mm_per_year", "north_mm_per_year", "up_mm_per_year", "sigma_east_mm_per_year", "sigma_north_mm_per_year", "sigma_up_mm_per_year", "duration_years"),
    ("sigma_east_mm_per_year", "sigma_north_mm_per_year", "sigma_up_mm_per_year"),
)
_NUMBER = re.compile(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?")
_FIELD = r'(?:"(?:[^"]|"")*"|[^",]*)'
_QUOTED = f"^(?s:{_FIELD}(?:,{_FIELD})*)$".replace("^", r"\A").replace("$", r"\z")
_NUMBER_RE2 = r"\A[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"
BLANKS = " \t"


def split_record(text: str) -> list[str] | None:
    """Fields of one record; None when its quoting is broken: a quote mark must
    enclose a whole field or be doubled inside an enclosed one."""
    fields, i, n = [], 0, len(text)
    while True:
        if i < n and text[i] == '"':
            part, i = [], i + 1
            while True:
                j = text.find('"', i)
                if j < 0:
                    return None
                part.append(text[i:j])
                if text[j + 1 : j + 2] != '"':
                    break
                part.append('"')
                i = j + 2
            fields.append("".join(part))
            i = j + 1
            if i < n and text[i] != ",":
                return None
        else:
            j = text.find(",", i)
            j = n if j < 0 else j
            if '"' in text[i:j]:
                return None
            fields.append(text[i:j])
            i = j
        if i >= n:
            return fields
        i += 1  # the comma; a field follows, if only an empty one


def number(text: str) -> float | None:
    """The value of a numeric field, None for a gap; ValueError if invalid."""
    bare = text.strip(BLANKS)
    if bare in ("", "NaN"):
        return None
    if not _NUMBER.fullmatch(bare) or not math.isfinite(value := float(bare)):
        raise ValueError(text)
    return value


def diagnose(text: str | None, layout: Layout) -> tuple[str | None, list]:
    """The first reason that applies, or None and the typed fields."""
    if text is None:
        return COUNT, []
    fields = split_record(text[:-1] if text.endswith("\r") else text)
    if fields is None:
        return BROKEN, []
    if len(fields) != len(layout.names):
        return COUNT, []
    out: list = []
    for name, field in zip(layout.names, fields, strict=True):
        if name not in layout.numbers:
            out.append(field)
            continue
        try:
            value = number(field)
        except ValueError:
            return VALUE, []
        if value is not None and value < 0 and name in layout.not_negative:
            return VALUE, []
        out.append(value)
    return None, out


class _Failed(Exception):
    """The structure of a block is not sound."""


def bulk(lines: pa.StringArray, layout: Layout) -> tuple[list[pa.Array], np.ndarray]:
    """Typed columns of a block and which records have only valid values.

    Raises when the block does not parse into one whole record for each line.
    """
    quoted = pc.match_substring(lines, '"')
    if pc.any(quoted).as_py() and not pc.all(pc.match_substring_regex(lines.filter(quoted), _QUOTED)).as_py():
        raise _Failed
    text = "\n".join(lines.to_pylist()).encode()
    names = list(layout.names)
    try:
        table = pv.read_csv(
            io.BytesIO(text),
            pv.ReadOptions(column_names=names, use_threads=False, block_size=max(1 << 16, 2 * len(text) + 16)),
            pv.ParseOptions(newlines_in_values=True, ignore_empty_lines=False),
            pv.ConvertOptions(column_types=dict.fromkeys(names, pa.string()), strings_can_be_null=False, check_utf8=False),
        )
    except pa.ArrowInvalid as e:
        raise _Failed from e
    if table.num_rows != len(lines):
        raise _Failed
    good, out = np.ones(len(lines), bool), []
    for name in names:
        col = table.column(name).combine_chunks()
        if name in layout.numbers:
            bare = pc.utf8_trim(col, BLANKS)
            gap = pc.or_(pc.equal(bare, ""), pc.equal(bare, "NaN"))
            plain = pc.match_substring_regex(bare, _NUMBER_RE2)
            good &= pc.or_(gap, plain).to_numpy(zero_copy_only=False)
            kept = pc.if_else(plain, pc.utf8_ltrim(bare, "+"), pa.scalar(None, pa.string()))
            col = kept.cast(pa.float64())
            value = col.to_numpy(zero_copy_only=False)
            with np.errstate(invalid="ignore"):
                good &= np.isnan(value) | np.isfinite(value)
                if name in layout.not_negative:
                    good &= ~(value < 0)
        out.append(col)
    return out, good


def parse_lines(lines: pa.StringArray, layout: Layout) -> tuple[list[pa.Array], list[str | None]]:
    """Columns and reasons, in the order of the lines."""
    found: list[tuple[int, list[pa.Array], list[str | None]]] = []

    def strict(at: int, part: list[str | None]) -> None:
        each = [diagnose(t, layout) for t in part]
        cols = [pa.array([v[i] if r is None else None for r, v in each], pa.float64() if name in layout.numbers else pa.string()) for i, name in enumerate(layout.names)]
        found.append((at, cols, [r for r, _ in each]))

    def walk(at: int, part: pa.StringArray) -> None:
        todo = [(at, part)]
        while todo:
            at, part = todo.pop()
            if len(part) <= LEAF:
                strict(at, part.to_pylist())
                continue
            try:
                cols, good = bulk(trimmed.slice(at, len(part)), layout)
            except (_Failed, pa.ArrowInvalid):
                half = len(part) // 2
                todo += [(at + half, part.slice(half)), (at, part.slice(0, half))]
                continue
            start = 0
            for bad in np.flatnonzero(~good):
                if bad > start:
                    found.append((at + start, [c.slice(start, bad - start) for c in cols], [None] * int(bad - start)))
                strict(at + int(bad), [part[int(bad)].as_py()])
                start = int(bad) + 1
            if start < len(part):
                found.append((at + start, [c.slice(start) for c in cols], [None] * (len(part) - start)))

    trimmed = pc.replace_substring_regex(lines, r"\r\z", "") if len(lines) else lines
    known = np.flatnonzero(lines.is_valid().to_numpy(zero_copy_only=False))
    # Nulls are no text: they fail by themselves and would break a block.
    edges = np.flatnonzero(np.diff(known) != 1) + 1 if len(known) else []
    for run in np.split(known, edges):
        for i in range(0, len(run), BLOCK):
            walk(int(run[i]), lines.slice(int(run[i]), min(BLOCK, len(run) - i)))
    for i in np.flatnonzero(~lines.is_valid().to_numpy(zero_copy_only=False)):
        strict(int(i), [None])
    found.sort(key=lambda x: x[0])
    cols = [pa.chunked_array([f[1][i] for f in found], pa.float64() if name in layout.numbers else pa.string()) for i, name in enumerate(layout.names)]
    return cols, [r for f in found for r in f[2]]


def parse_records(lines: DataFrame, line_id: str = "line_id", text: str = "raw_text", layout: Layout = STATION_LINE) -> DataFrame:
    """``line_id, reason`` and the typed columns of the layout, for every line.

    ``reason`` is null for a line that loads; otherwise it is the first that
    applies of ``broken_quoting``, ``wrong_column_count``, ``invalid_value`` and
    the columns are null. A null or empty text has the wrong number of columns.
    An empty numeric field or ``NaN`` is a gap (null). Repeated lines stay;
    extra columns are dropped, those of clashing names too. Nothing is shuffled.
    """
    kind = lines.schema[line_id].dataType.simpleString()
    schema = f"{line_id} {kind}, reason string, " + ", ".join(f"{n} {'double' if n in layout.numbers else 'string'}" for n in layout.names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.string())
            cols, reasons = parse_lines(texts, layout)
            flat = [c.combine_chunks() for c in cols]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(reasons, pa.string()), *flat], [line_id, "reason", *layout.names])

    return lines.select(F.col(line_id), F.col(text).cast("string")).mapInArrow(scan, schema)


def rejected(parsed: DataFrame, line_id: str = "line_id") -> DataFrame:
    return parsed.where(F.col("reason").isNotNull()).select(line_id, "reason")


def loaded(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reason").isNull()).drop("reason")
