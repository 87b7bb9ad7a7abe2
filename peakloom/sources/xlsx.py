"""Excel workbooks by the standard library alone: a workbook is a zip of XML parts. They are files that a person opens, so
they are read and written on the driver, row by row; a sheet has at most ``MOST_ROWS`` rows."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

#: Fixed by the file format.
MOST_ROWS = 1_048_576
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_NOT_XML = re.compile("[^\t\n\r\x20-퟿-�\U00010000-\U0010ffff]")
_LETTERS = re.compile("[A-Z]+")


def column_number(reference: str) -> int:
    """0 for A1, 26 for AA1."""
    n = 0
    for c in _LETTERS.match(reference)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def sheet_names(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, part) of each sheet, in the workbook's order."""
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{{{MAIN}}}sheet"):
        part = targets[s.get(f"{{{REL}}}id")]
        out.append((s.get("name"), part.lstrip("/") if part.startswith("/") else f"xl/{part}"))
    return out


def read_rows(path: str, sheet: str | None = None) -> Iterator[list]:
    """Rows of a sheet (the first one by default): numbers, strings, booleans, and None for empty cells."""
    with zipfile.ZipFile(path) as book:
        sheets = sheet_names(book)
        part = sheets[0][1] if sheet is None else dict(sheets)[sheet]
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{MAIN}}}t")) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).findall(f"{{{MAIN}}}si")]
        with book.open(part) as f:
            for _, row in ElementTree.iterparse(f):
                if row.tag != f"{{{MAIN}}}row":
                    continue
                out: list = []
                for c in row.findall(f"{{{MAIN}}}c"):
                    at = column_number(c.get("r")) if c.get("r") else len(out)
                    out += [None] * (at - len(out))
                    out.append(_value(c, shared))
                yield out
                row.clear()


def _value(c: ElementTree.Element, shared: list[str]):
    kind, v = c.get("t"), c.find(f"{{{MAIN}}}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in c.iter(f"{{{MAIN}}}t"))
    if v is None or v.text is None:
        return None
    if kind == "s":
        return shared[int(v.text)]
    if kind == "b":
        return v.text == "1"
    return v.text if kind in ("str", "e") else float(v.text)


def _cell(value) -> str:
    if value is None or value != value:
        return "<c/>"
    if isinstance(value, bool):
        return f'<c t="b"><v>{int(value)}</v></c>'
    if isinstance(value, int | float) and abs(value) != float("inf"):
        return f"<c><v>{value!r}</v></c>"
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(_NOT_XML.sub("", str(value)))}</t></is></c>'


def write_workbook(path: str, sheets: dict[str, Iterable[Iterable]]) -> None:
    """A workbook of the named sheets, each given as rows."""
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
    numbers = range(1, len(sheets) + 1)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in numbers)
        book.writestr(
            "[Content_Types].xml",
            f'{head}<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
            f'<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>',
        )
        book.writestr("_rels/.rels", f'{head}<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        names = "".join(f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="rId{i}"/>' for i, n in zip(numbers, sheets, strict=True))
        book.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{MAIN}" xmlns:r="{REL}"><sheets>{names}</sheets></workbook>')
        parts = "".join(f'<Relationship Id="rId{i}" Type="{REL}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in numbers)
        book.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{PACKAGE}/relationships">{parts}</Relationships>')
        for i, rows in zip(numbers, sheets.values(), strict=True):
            with book.open(f"xl/worksheets/sheet{i}.xml", "w") as f:
                f.write(f'{head}<worksheet xmlns="{MAIN}"><sheetData>'.encode())
                for k, row in enumerate(rows):
                    if k == MOST_ROWS:
                        raise ValueError(f"a sheet holds at most {MOST_ROWS} rows")
                    f.write(f"<row>{''.join(map(_cell, row))}</row>".encode())
                f.write(b"</sheetData></worksheet>")
