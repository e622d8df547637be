"""Delivered lines that fail to parse, with the reason, apart from the typed rows of all others.

Blocks of lines go through a columnar parser at once. A block that fails in any way is cut in half and both
halves are tried again, until the bad lines are isolated in a few neighbours; these are read character by
character by a strict parser that names the reason. Nothing is known of a single line before that.

A block passes only if every line of it is certainly valid. Every line is parsed behind a mark that no line holds,
so that one with an open quote or a line break can't pass for two or swallow its neighbour; the columnar parser is
lenient about text beside quotes, so a block with quotes must also have the shape of quoted fields.
"""

from __future__ import annotations

import datetime
import io
import math
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pacsv
from pyspark.sql import DataFrame

FIELDS = (
    "plt_cn", "statecd", "unitcd", "countycd", "plot", "eco", "measdate", "species_symbol", "species_symbol_map",
    "sftwd_hrdwd", "age_calc", "agb", "tree_count", "subp_has_dstrb", "remark",
)
WHOLE = ("statecd", "unitcd", "countycd", "plot", "age_calc", "tree_count")
BLOCK = 1024
#: A failing block of this size isn't cut again: reading its lines strictly costs less than parsing it once more.
LEAF = 64
SCHEMA = "line_id long, reason string, " + ", ".join(
    f"{f} {'long' if f == 'plt_cn' else 'date' if f == 'measdate' else 'double' if f == 'agb' else 'int' if f in WHOLE else 'string'}" for f in FIELDS
)
_KINDS = {f: pa.int64() if f == "plt_cn" else pa.date32() if f == "measdate" else pa.float64() if f == "agb" else pa.int32() if f in WHOLE else pa.string() for f in FIELDS}
_FIELD = r'(?:[^",\r\n]*|"(?:[^"]|"")*")'
STRUCTURE = f"^{_FIELD}(?:,{_FIELD}){{{len(FIELDS) - 1}}}$"
NUMBER = r"^(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
KEY, DAY, INTEGER = r"^[0-9]{1,15}$", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$", r"^[+-]?[0-9]{1,10}$"
_KEY, _DAY, _NUMBER, _INTEGER = (re.compile(x.replace("$", r"\Z")) for x in (KEY, DAY, NUMBER, INTEGER))


def whole(text: str) -> int | None:
    """A whole number of 32 bits, else None."""
    n = int(text) if _INTEGER.match(text) else None
    return n if n is not None and -(1 << 31) <= n < 1 << 31 else None


def split_strict(line: str) -> list[str] | None:
    """The fields of a line; None if its quoting is broken. Line breaks outside quotes are ordinary characters."""
    fields, at, n = [], 0, len(line)
    while True:
        if at < n and line[at] == '"':
            parts, at = [], at + 1
            while True:
                end = line.find('"', at)
                if end < 0:
                    return None
                parts.append(line[at:end])
                at = end + 1
                if at < n and line[at] == '"':
                    parts.append('"')
                    at += 1
                else:
                    break
            if at < n and line[at] != ",":
                return None
            fields.append("".join(parts))
        else:
            end = line.find(",", at)
            end = n if end < 0 else end
            if '"' in line[at:end]:
                return None
            fields.append(line[at:end])
            at = end
        if at >= n:
            return fields
        at += 1


def diagnose(line: str | None) -> tuple[str | None, dict]:
    """(reason, {}) of a bad line or (None, typed values). A null line has no columns."""
    if line is None:
        return "column_count", {}
    fields = split_strict(line)
    if fields is None:
        return "quoting", {}
    if len(fields) != len(FIELDS):
        return "column_count", {}
    row = dict(zip(FIELDS, fields, strict=True))
    if not _KEY.match(row["plt_cn"]) or not _DAY.match(row["measdate"]):
        return "invalid_value", {}
    try:
        day = datetime.date(*map(int, row["measdate"].split("-")))
    except ValueError:
        return "invalid_value", {}
    agb = row["agb"]
    if agb and not (_NUMBER.match(agb) and math.isfinite(float(agb))):
        return "invalid_value", {}
    typed: dict = {f: whole(v) if f in WHOLE else v for f, v in row.items()}
    return None, typed | {"plt_cn": int(row["plt_cn"]), "measdate": day, "agb": float(agb) if agb else None}


def _joined(lines: pa.Array, before: str) -> bytes:
    """All lines of a block as one text, each behind a mark and closed by a line break."""
    marked = pc.binary_join_element_wise(pa.scalar(before), pc.fill_null(lines, ""), ",")
    whole = pc.binary_join(pa.LargeListArray.from_arrays(pa.array([0, len(lines)], pa.int64()), marked), "\n")
    return whole[0].as_buffer().to_pybytes() + b"\n"


def parse_block(lines: pa.Array) -> pa.Table | None:
    """The typed columns of a block in which every line is certainly valid, else None."""
    if lines.null_count:
        return None
    mark = uuid.uuid4().hex
    text = _joined(lines, mark)
    try:
        t = pacsv.read_csv(
            io.BytesIO(text),
            read_options=pacsv.ReadOptions(column_names=["mark", *FIELDS], use_threads=False, block_size=max(1024, 2 * len(text))),
            parse_options=pacsv.ParseOptions(newlines_in_values=True, ignore_empty_lines=False),
            convert_options=pacsv.ConvertOptions(column_types=dict.fromkeys(["mark", *FIELDS], pa.string()), strings_can_be_null=False, check_utf8=True),
        )
        if t.num_rows != len(lines) or not pc.all(pc.equal(t["mark"], mark)).as_py():
            return None
        if b'"' in text:
            quoted = lines.filter(pc.match_substring(lines, '"'))
            if not pc.all(pc.match_substring_regex(quoted, STRUCTURE)).as_py():
                return None
        day, agb = t["measdate"], t["agb"]
        empty = pc.equal(agb, "")
        fine = pc.and_(pc.match_substring_regex(t["plt_cn"], KEY), pc.match_substring_regex(day, DAY))
        fine = pc.and_(fine, pc.or_(empty, pc.match_substring_regex(agb, NUMBER)))
        if not pc.all(pc.and_(fine, pc.invert(pc.starts_with(day, "0000")))).as_py():
            return None
        value = pc.cast(pc.if_else(empty, pa.scalar(None, pa.string()), agb), pa.float64())
        if not pc.all(pc.is_finite(value)).as_py():
            return None
        cols = {"plt_cn": pc.cast(t["plt_cn"], pa.int64()), "measdate": pc.cast(day, pa.date32()), "agb": value}
        for f in WHOLE:
            ok = pc.match_substring_regex(t[f], INTEGER)
            n = pc.cast(pc.if_else(ok, pc.utf8_ltrim(t[f], "+"), pa.scalar(None, pa.string())), pa.int64())
            cols[f] = pc.cast(pc.if_else(pc.and_(pc.greater_equal(n, -(1 << 31)), pc.less(n, 1 << 31)), n, pa.scalar(None, pa.int64())), pa.int32())
        return pa.table({f: cols.get(f, t[f]) for f in FIELDS})
    except pa.ArrowInvalid:
        return None


def parse_lines(ids: pa.Array, lines: pa.Array) -> Iterator[pa.Table]:
    """Tables of (line_id, reason, fields): good blocks as they are, the lines of small failing blocks one by one."""
    strict: list[tuple] = []
    todo = [(at, min(at + BLOCK, len(lines))) for at in range(0, len(lines), BLOCK)][::-1]
    while todo:
        lo, hi = todo.pop()
        t = parse_block(lines.slice(lo, hi - lo)) if hi - lo > 1 else None
        if t is not None:
            yield t.add_column(0, "reason", pa.nulls(hi - lo, pa.string())).add_column(0, "line_id", ids.slice(lo, hi - lo))
        elif hi - lo <= LEAF:
            strict += zip(ids.slice(lo, hi - lo).to_pylist(), map(diagnose, lines.slice(lo, hi - lo).to_pylist()), strict=True)
        else:
            mid = (lo + hi) // 2
            todo += [(mid, hi), (lo, mid)]
    if strict:
        cols = {"line_id": pa.array([i for i, _ in strict], pa.int64()), "reason": pa.array([d[0] for _, d in strict], pa.string())}
        yield pa.table(cols | {f: pa.array([d[1].get(f) for _, d in strict], _KINDS[f]) for f in FIELDS})


def parse(deliveries: DataFrame) -> DataFrame:
    """(line_id, reason, typed fields) of every line; ``reason`` is null for a valid one.

    Repeated line_ids give a row each; other columns of the input, also of clashing names, aren't read.
    Fields other than plt_cn, measdate and agb aren't judged: a whole number that isn't one is null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in parse_lines(b.column(0), b.column(1)):
                yield from t.combine_chunks().to_batches()

    return deliveries.select("line_id", "line").mapInArrow(run, SCHEMA)


def rejected(deliveries: DataFrame) -> DataFrame:
    """(line_id, reason), distinct."""
    return parse(deliveries).filter("reason is not null").select("line_id", "reason").distinct()


def loaded(deliveries: DataFrame) -> DataFrame:
    """The typed rows of the valid lines."""
    return parse(deliveries).filter("reason is null").drop("reason")
