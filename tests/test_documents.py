"""Document readers over hand-made files and archives, and the layouts of sheets against plain code."""

from __future__ import annotations

import io
import random
import zipfile

import pytest

from bidlake import catalog
from bidlake.sources import documents
from tests.oracle import SMALL, connection, differences

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def zipped(files: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for name, data in files.items():
            archive.writestr(name, data)
    return out.getvalue()


def workbook(sheets: dict[str, list[list[str]]]) -> bytes:
    """Sheets with inline texts; blank rows and cells are left out, as spreadsheets do."""
    files, rels, listed = {}, [], []
    for n, (name, rows) in enumerate(sheets.items(), 1):
        cells = lambda i, row: "".join(f'<c r="{chr(65 + j)}{i}" t="inlineStr"><is><t>{v}</t></is></c>' for j, v in enumerate(row) if v)
        body = "".join(f'<row r="{i}">{cells(i, row)}</row>' for i, row in enumerate(rows, 1) if any(row))
        files[f"xl/worksheets/sheet{n}.xml"] = f'<worksheet xmlns="{MAIN}"><sheetData>{body}</sheetData></worksheet>'.encode()
        rels.append(f'<Relationship Id="r{n}" Target="worksheets/sheet{n}.xml"/>')
        listed.append(f'<sheet name="{name}" r:id="r{n}"/>')
    files["xl/workbook.xml"] = f'<workbook xmlns="{MAIN}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{"".join(listed)}</sheets></workbook>'.encode()
    files["xl/_rels/workbook.xml.rels"] = f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{"".join(rels)}</Relationships>'.encode()
    return zipped(files)


def letter() -> bytes:
    p = lambda text: f"<w:p><w:r><w:t>{text}</w:t></w:r></w:p>"
    table = f"<w:tbl><w:tr><w:tc>{p('a')}{p('b')}</w:tc><w:tc>{p('c')}</w:tc></w:tr></w:tbl>"
    return zipped({"word/document.xml": f'<w:document xmlns:w="{WORD}"><w:body>{p("One")}{p(" ")}{table}{p("Two")}</w:body></w:document>'.encode()})


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "deep").mkdir()
    book = workbook({"First": [["x", "", "y"]], "Second": [["1"], [], ["z"]]})
    good = zipped({"a/letter.docx": letter(), "book.xlsx": book, "note.txt": "ü".encode(), "photo.jpg": b"j", "folder/": b"", "broken.docx": b"no zip"})
    (tmp_path / "deep/all.zip").write_bytes(good)
    (tmp_path / "bad.zip").write_bytes(b"no zip")
    damaged = bytearray(zipped({"first.txt": b"first text" * 9, "second.txt": b"second"}))
    damaged[damaged.index(b"first text") + 3] ^= 1
    (tmp_path / "half.zip").write_bytes(bytes(damaged))
    (tmp_path / "plain.txt").write_bytes(b"plain")
    (tmp_path / "empty.txt").write_bytes(b"")
    (tmp_path / "broken.xlsx").write_bytes(b"x")
    (tmp_path / "photo.png").write_bytes(b"p")
    return tmp_path


EXPECTED = {
    ("all.zip", "a/letter.docx"): ("One\nTwo", [(None, [["a\nb", "c"]])], None),
    ("all.zip", "book.xlsx"): ("x\t\ty\n1\nz", [("First", [["x", "", "y"]]), ("Second", [["1"], [], ["z"]])], None),
    ("all.zip", "note.txt"): ("ü", [], None),
    ("all.zip", "broken.docx"): (None, [], "BadZipFile"),
    ("bad.zip", None): (None, [], "bad zip"),
    ("half.zip", "first.txt"): (None, [], "BadZipFile"),
    ("half.zip", "second.txt"): ("second", [], None),
    ("plain.txt", None): ("plain", [], None),
    ("broken.xlsx", None): (None, [], "BadZipFile"),
}


def found(frame):
    return {(r["path"].rsplit("/", 1)[-1], r["member"]): (r["text"], [(t["name"], t["rows"]) for t in r["tables"]], r["parse_error"] and r["parse_error"].split(":")[0]) for r in frame.collect()}


def test_documents_of_a_folder(spark, folder):
    assert found(documents.read_documents(spark, str(folder))) == EXPECTED
    spark.dataSource.register(documents.DocumentSource)
    read = spark.read.format("documents").option("partitions", 3).load(str(folder))
    assert read.rdd.getNumPartitions() == 3 and found(read) == EXPECTED
    assert found(spark.read.format("documents").load(str(folder / "plain.txt"))) == {("plain.txt", None): ("plain", [], None)}


def test_readers_can_be_added(spark, folder):
    more = {".png": ("image/png", lambda content: (f"{len(content)} bytes", []))}
    assert found(documents.read_documents(spark, str(folder), more)) == {("bad.zip", None): (None, [], "bad zip"), ("photo.png", None): ("1 bytes", [], None)}
    nothing = spark.createDataFrame([("x.txt", None)], "path string, content binary")
    assert found(documents.documents(nothing)) == {("x.txt", None): ("", [], None)}


def plain_records(rows: list[list[str]]) -> tuple[str, list[tuple]]:
    rows = [[c.strip() for c in r] for r in rows]
    while rows and not any(rows[0]):
        rows = rows[1:]
    end = next((i for i, r in enumerate(rows) if not any(r)), len(rows))
    rows = rows[:end]
    if not rows:
        return "", []

    def number(c):
        try:
            float(c.replace(",", "").replace(" ", ""))
        except ValueError:
            return False
        return True

    pairs = sum(len(r) >= 2 and r[0] != "" and len(r[0]) < 60 and r[1] != "" for r in rows) > len(rows) / 2
    if len(rows[0]) >= 2 and (sum(map(number, rows[0])) > len(rows[0]) // 2 or pairs):
        held, last = {}, None
        for r in rows:
            label, value = (r[0].rstrip(":") if r else ""), (r[1] if len(r) > 1 else "")
            if label:
                held[label], last = value, label
            elif value and last is not None:
                held[last] = f"{held[last]} {value}".strip()
        return "key_value", [(i, k, v) for i, (k, v) in enumerate(held.items())]
    out = []
    for n, r in enumerate(rows[1:], 1):
        out += [(n, k, v) for k, v in {h: r[j] if j < len(r) else "" for j, h in enumerate(rows[0])}.items()]
    return "table", out


def test_layouts_by_plain_code(spark):
    draw = random.Random(3)
    cells = ["", "", "a", "b:", "c :", "1", "2,5", "-3e4", "nan", "label", "x" * 70, " y "]
    sheets = {f"s{i}": [[draw.choice(cells) for _ in range(draw.randrange(1, 4))] for _ in range(draw.randrange(0, 8))] for i in range(300)}
    sheets |= {"pairs": [["Name:", "A"], ["", "and B"], ["Name:", "C"], ["", "D"], ["Ref", "1"]], "table": [["h", "h", "i"], ["1", "2"], ["3", "4", "5"]], "none": [], "blank": [[""], [""]]}
    frame = spark.createDataFrame([("p", name, [(name, rows)]) for name, rows in sheets.items()], f"path string, member string, tables array<{documents.TABLE}>")
    got: dict = {}
    for r in documents.sheet_records(frame).collect():
        got.setdefault(r["sheet"], (r["layout"], []))[1].append((r["record"], r["label"], r["value"]))
    expected = {name: (layout, sorted(rows)) for name, (layout, rows) in ((n, plain_records(r)) for n, r in sheets.items()) if rows}
    assert {k: (layout, sorted(rows)) for k, (layout, rows) in got.items()} == expected
    assert {layout for layout, _ in expected.values()} == {"key_value", "table"}


def test_sheets_of_a_workbook(spark):
    book = workbook({"Facts": [["Buyer:", "City"], ["", "of Bonn"], ["Ref", "7"]], "Lots": [["no", "title"], ["1"], ["2", "b"], ["3"], [], ["later", "x"]]})
    frame = documents.documents(spark.createDataFrame([("t.xlsx", bytearray(book))], "path string, content binary"))
    assert sorted((r["sheet"], r["record"], r["label"], r["value"]) for r in documents.sheet_records(frame).collect()) == [
        ("Facts", 0, "Buyer", "City of Bonn"), ("Facts", 1, "Ref", "7"), ("Lots", 1, "no", "1"), ("Lots", 1, "title", ""), ("Lots", 2, "no", "2"), ("Lots", 2, "title", "b"), ("Lots", 3, "no", "3"), ("Lots", 3, "title", ""),
    ]


def test_whole_texts_as_sheets(spark):
    assert not differences(catalog.queries()["sheet_records"](spark, SMALL), connection(), catalog.oracle_sql()["sheet_records"])
