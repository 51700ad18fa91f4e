"""Documents of all kinds as rows: a data source over archive members, sheets with their layouts, and readers that can be added."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from bidlake.sources.archives import files

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_LINKS = "{http://schemas.openxmlformats.org/package/2006/relationships}Relationship"
#: A member's row: tables are lists of rows of cells.
TABLE = "struct<name:string,rows:array<array<string>>>"
SCHEMA = f"path string, member string, mime string, text string, tables array<{TABLE}>, parse_error string"
Parsed = tuple[str, list[dict]]


def docx_document(content: bytes) -> Parsed:
    """Paragraphs outside of tables that aren't blank, a line each, and the tables."""
    body = ET.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml"))
    inside = {id(p) for table in body.iter(f"{_W}tbl") for p in table.iter(f"{_W}p")}
    said = lambda node: "".join(t.text or "" for t in node.iter(f"{_W}t"))
    lines = [said(p) for p in body.iter(f"{_W}p") if id(p) not in inside]
    tables = [{"name": None, "rows": [["\n".join(said(p) for p in cell.iter(f"{_W}p")).strip() for cell in row.findall(f"{_W}tc")] for row in table.findall(f"{_W}tr")]} for table in body.iter(f"{_W}tbl")]
    return "\n".join(x for x in lines if x.strip()), tables


def _column(reference: str, at: int) -> int:
    """The column of a cell such as C7; where it isn't said, the next."""
    letters = re.match("[A-Z]{1,3}", reference)
    if not letters:
        return at
    number = 0
    for letter in letters[0]:
        number = 26 * number + ord(letter) - 64
    return number - 1


def sheets(content: bytes) -> list[dict]:
    """The sheets of a workbook in their order, with all cells in their columns, as text."""
    book = zipfile.ZipFile(io.BytesIO(content))
    names, shared = set(book.namelist()), []
    said = lambda node: "".join(t.text or "" for t in node.iter(f"{_S}t"))
    if "xl/sharedStrings.xml" in names:
        shared = [said(si) for si in ET.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_S}si")]
    order = [(f"Sheet{i + 1}", n) for i, n in enumerate(sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0])))]
    if {"xl/workbook.xml", "xl/_rels/workbook.xml.rels"} <= names:
        targets = {r.get("Id"): r.get("Target", "").lstrip("/") for r in ET.fromstring(book.read("xl/_rels/workbook.xml.rels")).iter(_LINKS)}
        listed = [(s.get("name"), targets.get(s.get(f"{_R}id"), "")) for s in ET.fromstring(book.read("xl/workbook.xml")).iter(f"{_S}sheet")]
        order = [(n, t if t.startswith("xl/") else f"xl/{t}") for n, t in listed]
    out = []
    for name, place in order:
        if place not in names:
            continue
        rows: list[list[str]] = []
        seen = 0
        for row in ET.fromstring(book.read(place)).iter(f"{_S}row"):
            cells: list[str] = []
            number = int(row.get("r") or seen + 1)
            rows += [[]] if number > seen + 1 else []  # rows that are left out are blank; one stands for all
            seen = number
            for cell in row.iter(f"{_S}c"):
                at = _column(cell.get("r") or "", len(cells))
                value = getattr(cell.find(f"{_S}v"), "text", None)
                kind = cell.get("t")
                text = shared[int(value)] if kind == "s" and value else said(cell) if kind == "inlineStr" else {"1": "TRUE", "0": "FALSE"}.get(value, value) if kind == "b" else value
                cells += [""] * (at + 1 - len(cells))
                cells[at] = (text or "").strip()
            rows.append(cells)
        out.append({"name": name, "rows": rows})
    return out


def xlsx_document(content: bytes) -> Parsed:
    """Rows that aren't blank, a line each with cells apart by tabs, and the sheets."""
    found = sheets(content)
    lines = ["\t".join(row).rstrip("\t") for sheet in found for row in sheet["rows"]]
    return "\n".join(x for x in lines if x.strip()), found


def text_document(content: bytes) -> Parsed:
    return content.decode("utf-8", "replace"), []


#: Readers by suffix; more can be given to ``member_rows``.
READERS: dict[str, tuple[str, Callable[[bytes], Parsed]]] = {
    ".docx": ("application/vnd.openxmlformats-officedocument.wordprocessingml.document", docx_document),
    ".xlsx": ("application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", xlsx_document),
    **{s: ("text/plain", text_document) for s in (".txt", ".xml", ".html", ".htm", ".csv")},
}


def suffix(name: str) -> str:
    base = re.split(r"[\\/]", name)[-1].lower()
    return base[base.rindex(".") :] if "." in base[1:] else ""


def parsed(path: str, member: str | None, content: bytes, readers: dict) -> tuple:
    """One row; a file that can't be read says why and has no text."""
    mime, read = readers[suffix(member or path)]
    try:
        text, tables = read(content)
        return path, member, mime, text, tables, None
    except Exception as e:  # a damaged file is a row, not the end of the job
        return path, member, mime, None, [], f"{type(e).__name__}: {e}"[:200]


def member_rows(path: str, content: bytes, readers: dict | None = None) -> Iterator[tuple]:
    """The documents of a file, or of an archive's members, one at a time; kinds without a reader give no rows."""
    known = READERS if readers is None else readers
    if suffix(path) != ".zip":
        if suffix(path) in known:
            yield parsed(path, None, content, known)
        return
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile as e:
        yield path, None, "application/zip", None, [], f"bad zip: {e}"
        return
    for info in archive.infolist():
        if info.filename.endswith("/") or suffix(info.filename) not in known:
            continue
        try:
            data = archive.read(info)
        except Exception as e:  # of this member alone
            yield path, info.filename, known[suffix(info.filename)][0], None, [], f"{type(e).__name__}: {e}"[:200]
            continue
        yield parsed(path, info.filename, data, known)


def documents(found: DataFrame, readers: dict | None = None) -> DataFrame:
    """SCHEMA of (path, content) such as ``archives.files`` gives: any store that Spark reads.

    ``readers`` maps suffixes to (MIME type, function of the bytes to text and tables), in place of READERS. Members are given one by one, so that no archive's
    texts are in memory together. A null content is an empty file.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.list_(pa.struct([("name", pa.string()), ("rows", pa.list_(pa.list_(pa.string())))]))
        kinds = [pa.string(), pa.string(), pa.string(), pa.string(), table, pa.string()]
        for batch in batches:
            for i in range(batch.num_rows):
                for row in member_rows(batch.column(0)[i].as_py(), batch.column(1)[i].as_py() or b"", readers):
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=["path", "member", "mime", "text", "tables", "parse_error"])

    return found.select("path", "content").mapInArrow(work, SCHEMA)


class _Part(InputPartition):
    def __init__(self, names: list[str]) -> None:
        self.names = names


class _Reader(DataSourceReader):
    def __init__(self, path: str, parts: int) -> None:
        self.path, self.parts = path, parts

    def partitions(self) -> list[InputPartition]:
        from pathlib import Path

        root = Path(self.path)
        found = sorted(((p.stat().st_size, str(p)) for p in ([root] if root.is_file() else root.rglob("*")) if p.is_file() and p.stat().st_size), reverse=True)
        dealt: list[tuple[int, list[str]]] = [(0, []) for _ in range(max(1, min(self.parts, len(found))))]
        for size, name in found:  # the largest first, each to the smallest part
            at = min(range(len(dealt)), key=lambda i: dealt[i][0])
            dealt[at][1].append(name)
            dealt[at] = (dealt[at][0] + size, dealt[at][1])
        return [_Part(names) for _, names in dealt]

    def read(self, partition: _Part) -> Iterator[tuple]:
        for name in partition.names:
            with open(name, "rb") as file:
                content = file.read()
            for path, member, mime, text, tables, error in member_rows(name, content):
                yield path, member, mime, text, [(t["name"], t["rows"]) for t in tables], error


class DocumentSource(DataSource):
    """``spark.read.format("documents").load(path)``: documents and members of archives below a mounted folder, some files a partition.

    For a folder that every executor sees; files in a store that only Spark reads go through ``read_documents`` instead. Files without a byte are left out. Option ``partitions``: how many at most (8).
    """

    @classmethod
    def name(cls) -> str:
        return "documents"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("partitions", 8)))


def read_documents(spark: SparkSession, path: str, readers: dict | None = None) -> DataFrame:
    """All documents below ``path``, in any store, by the readers; Spark leaves out files without a byte."""
    return documents(files(spark, path), readers)


# Sheets as fields
#: Letters that a label has at most, rounded down share of rows that must be pairs.
LABEL, PAIRS = 60, 0.5
#: Fixed value: blanks that are cut off cells, all of Unicode's space separators.
BLANKS = "\u0020\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def _trimmed(cell: str) -> str:
    return f"trim(BOTH '{BLANKS}' FROM {cell})"


def used_rows(rows: str) -> str:
    """SQL for the rows of a sheet from the first that isn't blank to the one before the next blank one."""
    blank = f"not exists(r, c -> {_trimmed('c')} <> '')"
    return f"aggregate({rows}, named_struct('rows', cast(array() as array<array<string>>), 'over', false), (s, r) -> case when s.over then s when {blank} then named_struct('rows', s.rows, 'over', size(s.rows) > 0) else named_struct('rows', concat(s.rows, array(transform(r, c -> {_trimmed('c')}))), 'over', false) end, s -> s.rows)"


def _numeric(cell: str) -> str:
    return f"regexp_replace({cell}, '[ ,]', '') rlike '(?i)^[+-]?(([0-9]+([.][0-9]*)?|[.][0-9]+)(e[+-]?[0-9]+)?|inf|infinity|nan)\\\\z'"


def sheet_records(found: DataFrame) -> DataFrame:
    """(path, member, sheet, layout, record, label, value) of the sheets in documents (path, member, tables).

    A sheet is read from its first row with a value to the next blank row. It is of pairs if most of its first row's cells are numbers, or if more than half of its rows have
    a label of under LABEL letters in column 1 and a value in column 2; else it is a table under its first row. Pairs: a fold
    over the rows holds the open label; a row without one goes on with its value after a blank, a repeated label starts anew and the last counts;
    record is the place of the label's first row. Tables: each row that isn't blank, from 1, has a value for every header, empty where it is too short, of equal headers the last. Cells' nulls are empty; a
    sheet without rows gives nothing.
    """
    sheet = found.select("path", "member", F.posexplode("tables").alias("_at", "_t")).select("path", "member", "_at", F.col("_t.name").alias("sheet"), F.expr("transform(_t.rows, r -> transform(r, c -> coalesce(c, '')))").alias("_all"))
    used = sheet.withColumn("_rows", F.expr(used_rows("_all"))).filter("size(_rows) > 0").drop("_all")
    numbers = f"size(filter(get(_rows, 0), c -> {_numeric('c')})) > size(get(_rows, 0)) div 2"
    pairs = f"size(filter(_rows, r -> size(r) >= 2 and r[0] <> '' and length(r[0]) < {LABEL} and r[1] <> '')) > size(_rows) * {PAIRS}D"
    layout = f"case when size(get(_rows, 0)) < 2 then 'table' when {numbers} or {pairs} then 'key_value' else 'table' end"
    laid = used.withColumn("layout", F.expr(layout))
    # The fold: what is done, and the open label's place.
    label = "trim(TRAILING ':' FROM r[0])"  # used rows' cells are trimmed
    value = "coalesce(get(r, 1), '')"
    step = f"""(s, r) -> case when {label} <> '' then concat(filter(s, x -> x.label <> {label}), array(named_struct('label', {label}, 'value', {value}, 'first', coalesce(get(filter(s, x -> x.label = {label}), 0).first, size(s)))))
        when {value} <> '' and size(s) > 0 then concat(slice(s, 1, size(s) - 1), array(named_struct('label', element_at(s, -1).label, 'value', {_trimmed("concat(element_at(s, -1).value, ' ', " + value + ')')}, 'first', element_at(s, -1).first)))
        else s end"""
    folded = f"aggregate(_rows, cast(array() as array<struct<label:string,value:string,first:int>>), {step})"
    kept = laid.filter("layout = 'key_value'").select("path", "member", "sheet", "layout", F.explode(F.expr(folded)).alias("_p"))
    by_pair = kept.select("path", "member", "sheet", "layout", F.col("_p.first").alias("record"), F.col("_p.label").alias("label"), F.col("_p.value").alias("value"))
    body = laid.filter("layout = 'table'").select("path", "member", "sheet", "layout", F.expr("get(_rows, 0)").alias("_heads"), F.posexplode(F.expr("slice(_rows, 2, size(_rows))")).alias("record", "_row"))
    cells = body.select("path", "member", "sheet", "layout", (F.col("record") + 1).alias("record"), "_heads", "_row", F.posexplode("_heads").alias("_c", "label"))
    last = cells.filter("_c = size(_heads) - array_position(reverse(_heads), label)")
    by_cell = last.select("path", "member", "sheet", "layout", "record", "label", F.expr("coalesce(get(_row, _c), '')").alias("value"))
    return by_pair.unionByName(by_cell)
