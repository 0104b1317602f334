"""Rows that fail to parse: loading of delimited records with the failing ones set apart.

Records of one file layout are parsed in blocks. A block passes when a vectorised check finds every record
well formed and the columnar CSV reader gives as many rows and columns as expected. A block that doesn't
pass is cut in two, again and again, until the records at fault stand in blocks of a few records; these are
diagnosed by a strict reader which names the reason, while the other halves load on the fast path.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pacsv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import PLAIN_NUMBER
from ..sources.tables import need
from .skew import salted_lookup

#: Separators in order of preference on equal counts.
SEPARATORS = (",", ";", "|", "\t")

#: Names that vendors give the columns.
COLUMN_ALIASES = {
    "description": ("description", "desc", "item", "line_item", "line item", "item description"),
    "unit_cost": ("unit_cost", "unit cost", "rate", "price", "cost", "unit price", "unit_price"),
    "quantity": ("quantity", "qty", "q"),
    "unit_of_measure": ("unit_of_measure", "unit of measure", "uom", "unit"),
    "vendor": ("vendor", "supplier"),
    "quote_ref": ("quote_ref", "quote", "quote ref"),
    "notes": ("notes", "remarks", "comments"),
}
SLOTS = tuple(COLUMN_ALIASES)
_SLOT_OF = {alias: slot for slot, aliases in COLUMN_ALIASES.items() for alias in aliases}

#: Records in a block before any cut, and in one that is no longer cut but read strictly, record by record.
BLOCK, LEAF = 512, 16

_OUT = pa.schema([("line_id", pa.int64()), ("reason", pa.string()), *((s, pa.string()) for s in SLOTS)])
_NUMBER = re.compile(PLAIN_NUMBER)


def strict_cells(record: str, separator: str) -> list[str] | None:
    """Cells of one record, or None where a quote mark neither encloses a whole cell nor stands doubled inside one."""
    cells, at, end = [], 0, len(record)
    while True:
        if at < end and record[at] == '"':
            close = at + 1
            while True:
                close = record.find('"', close)
                if close < 0:
                    return None
                if close + 1 < end and record[close + 1] == '"':
                    close += 2
                    continue
                break
            cells.append(record[at + 1 : close].replace('""', '"'))
            at = close + 1
            if at == end:
                return cells
            if record[at] != separator:
                return None
        else:
            stop = record.find(separator, at)
            cell = record[at : end if stop < 0 else stop]
            if '"' in cell:
                return None
            cells.append(cell)
            if stop < 0:
                return cells
            at = stop
        at += 1


def read_header(header: str | None) -> tuple[str, list[str | None]]:
    """Separator of a header record and the slot of each column (None for a column we don't know)."""
    text = (header or "").lstrip("\ufeff")
    separator = max(SEPARATORS, key=text.count)
    cells = strict_cells(text, separator)
    if cells is None:
        cells = text.replace('"', "").split(separator)
    slots, seen = [], set()
    for cell in cells:
        slot = _SLOT_OF.get(" ".join(cell.strip().lower().split()))
        slots.append(None if slot in seen else slot)
        seen.add(slot)
    return separator, slots


def diagnose(record: str | None, separator: str, slots: list[str | None]) -> tuple[str | None, dict[str, str]]:
    """Reason of failure of one record (None if it is well formed) and its cells by slot."""
    cells = strict_cells(record or "", separator)
    if cells is None:
        return "quoting", {}
    if len(cells) != len(slots):
        return "columns", {}
    values = {slot: cell for slot, cell in zip(slots, cells) if slot}
    blank = not values.get("description", "").strip()
    quantity = values.get("quantity", "")
    wrong = blank or not _NUMBER.match(values.get("unit_cost", "")) or (quantity.strip() and not _NUMBER.match(quantity))
    return ("value" if wrong else None), values


def _shape(separator: str, columns: int) -> str:
    """RE2 pattern of a record with that many cells, each whole in quotes or free of them."""
    sep = re.escape(separator) if separator != "\t" else r"\t"
    cell = rf'("([^"]|"")*"|[^"{sep}]*)'
    return "(?s)^" + cell + (rf"{sep}{cell}" * (columns - 1)) + "$"


def _fast(records: pa.Array, separator: str, slots: list[str | None]) -> pa.Table | None:
    """Cells of a whole block, or None if any of its records is at fault."""
    if records.null_count or not pc.all(pc.match_substring_regex(records, _shape(separator, len(slots)))).as_py():
        return None
    body = "\n".join(records.to_pylist()).encode()
    names = [slot or f"unknown {i}" for i, slot in enumerate(slots)]
    try:
        table = pacsv.read_csv(
            io.BytesIO(body),
            read_options=pacsv.ReadOptions(column_names=names, use_threads=False, block_size=max(1 << 20, 2 * len(body))),
            parse_options=pacsv.ParseOptions(delimiter=separator, newlines_in_values=True, ignore_empty_lines=False),
            convert_options=pacsv.ConvertOptions(column_types={n: pa.string() for n in names}, strings_can_be_null=False),
        )
    except pa.ArrowInvalid:
        return None
    if table.num_rows != len(records):
        return None
    if "description" not in names or "unit_cost" not in names:
        return None
    good = [pc.match_substring_regex(table["description"], r"\S"), pc.match_substring_regex(table["unit_cost"], PLAIN_NUMBER)]
    if "quantity" in names:
        good.append(pc.match_substring_regex(table["quantity"], PLAIN_NUMBER + r"|^\s*$"))
    return table if all(pc.all(g).as_py() for g in good) else None


def _block(ids: pa.Array, records: pa.Array, separator: str, slots: list[str | None], out: list[pa.Table]) -> None:
    """Append the parsed rows of one block to `out`, cutting it in two while it fails."""
    todo = [(0, len(records))]
    while todo:
        at, size = todo.pop()
        part = records.slice(at, size)
        table = _fast(part, separator, slots)
        if table is not None:
            columns = [table[s].cast(pa.string()) if s in table.column_names else pa.nulls(size, pa.string()) for s in SLOTS]
            out.append(pa.table([ids.slice(at, size), pa.nulls(size, pa.string()), *columns], schema=_OUT))
        elif size > LEAF:
            half = size // 2
            todo += [(at + half, size - half), (at, half)]
        else:
            read = [diagnose(record, separator, slots) for record in part.to_pylist()]
            columns = [[reason for reason, _ in read], *([values.get(s) for _, values in read] for s in SLOTS)]
            out.append(pa.table([ids.slice(at, size), *(pa.array(c, pa.string()) for c in columns)], schema=_OUT))


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    layouts: dict[str | None, tuple[str, list[str | None]]] = {}
    for batch in batches:
        table = pa.Table.from_batches([batch])
        header = table["header"].combine_chunks()
        out: list[pa.Table] = []
        for value in pc.unique(header):
            layout = value.as_py()
            if layout not in layouts:
                layouts[layout] = read_header(layout)
            same = table.filter(pc.equal(header, value) if layout is not None else pc.is_null(header))
            ids, records = same["line_id"].combine_chunks(), same["raw_line"].combine_chunks()
            for at in range(0, len(records), BLOCK):
                _block(ids.slice(at, BLOCK), records.slice(at, BLOCK), *layouts[layout], out)
        if out:
            yield from pa.concat_tables(out).combine_chunks().to_batches()


def parse_records(lines: DataFrame) -> DataFrame:
    """Every record of `lines` (line_id, file_name, line_no, raw_line; line_no 1 is a file's header) with its cells.

    Result: line_id, reason (null for a row that loads; quoting, columns or value otherwise, the first that
    applies), the cells by slot as text. Headers give no row. Of several headers of one file the one with the
    smallest line_id counts. A file without a header, or one whose header names neither description nor unit
    cost, loads nothing: its records fail as `columns` or, with as many cells as the header, as `value`; a quote
    mark out of place is reported first in any case. Null and empty records have one empty cell. A null
    file_name is a file like any other.
    """
    rows = need(lines, "line_id", "file_name", "line_no", "raw_line").withColumn("file_key", F.coalesce(F.concat(F.lit("f:"), "file_name"), F.lit("null")))
    headers = (
        rows.where("line_no = 1")
        .groupBy("file_key")
        .agg(F.min_by(F.regexp_replace("raw_line", "^\ufeff", ""), "line_id").alias("header"))
    )
    records = rows.where("line_no is null or line_no <> 1").select("line_id", "raw_line", "file_key")
    joined = salted_lookup(records, headers, ["file_key"], "line_id", "left").select("line_id", "raw_line", "header")
    fields = ", ".join(["line_id bigint", "reason string", *(f"{s} string" for s in SLOTS)])
    return joined.mapInArrow(_parse_batches, fields)


def load_rows(lines: DataFrame) -> DataFrame:
    """The rows that load, typed: line_id, description, unit_cost, quantity, unit_of_measure, vendor, quote_ref, notes."""
    from ..functions.numbers import plain_number

    text = [F.nullif(F.trim(s), F.lit("")).alias(s) for s in ("unit_of_measure", "vendor", "quote_ref", "notes")]
    return (
        parse_records(lines)
        .where("reason is null")
        .select("line_id", F.trim("description").alias("description"), plain_number(F.col("unit_cost")).alias("unit_cost"), plain_number(F.col("quantity")).alias("quantity"), *text)
    )


def failed_rows(lines: DataFrame) -> DataFrame:
    """The records that fail: line_id, reason."""
    return parse_records(lines).where("reason is not null").select("line_id", "reason")
