"""Spreadsheet files by the standard library: a zip of XML parts, of which a few are enough for plain tables."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator, Mapping
from decimal import Decimal
from pathlib import Path
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame, SparkSession

# Names of the format, and the most that a sheet and its name can hold.
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
RELATION = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
MOST_ROWS, MOST_NAME, MOST_CELL = 1_048_576, 31, 32_767


def _letters(n: int) -> str:
    out = ""
    while n >= 0:
        out, n = chr(65 + n % 26) + out, n // 26 - 1
    return out


def _number(letters: str) -> int:
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n - 1


def sheet_names(wanted: list[str]) -> list[str]:
    """Names that a workbook can have: at most 31 characters, none of those that are forbidden, each one once."""
    out: list[str] = []
    for name in wanted:
        base = re.sub(r"[\[\]:*?/\\]", "_", name)[:MOST_NAME] or "Sheet"
        made, k = base, 2
        while made.lower() in {x.lower() for x in out}:
            made, k = f"{base[: MOST_NAME - len(str(k)) - 1]}_{k}", k + 1
        out.append(made)
    return out


def _cell(at: str, v) -> str:
    if v is None:
        return ""
    if isinstance(v, bool):
        return f'<c r="{at}" t="b"><v>{int(v)}</v></c>'
    if isinstance(v, (int, float, Decimal)) and abs(v) < 1e15 and v == v:
        return f'<c r="{at}"><v>{v}</v></c>'
    text = re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(v))[:MOST_CELL]
    return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def _sheet(df: DataFrame) -> Iterator[str]:
    yield f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{MAIN}"><sheetData>'
    letters = [_letters(i) for i in range(len(df.columns))]
    for n, row in enumerate((r for part in ([df.columns], df.toLocalIterator()) for r in part), 1):
        if n > MOST_ROWS:
            raise ValueError(f"a sheet has at most {MOST_ROWS} rows")
        yield f'<row r="{n}">' + "".join(_cell(f"{a}{n}", v) for a, v in zip(letters, row)) + "</row>"
    yield "</sheetData></worksheet>"


def write_xlsx(sheets: Mapping[str, DataFrame], path: str) -> None:
    """A workbook with a sheet for each table, header first, row by row through the driver. Too many rows are an error."""
    names = sheet_names(list(sheets))
    head = '<?xml version="1.0" encoding="UTF-8"?>'
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in range(1, len(names) + 1))
        out.writestr("[Content_Types].xml", f'{head}<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>{parts}</Types>')
        out.writestr("_rels/.rels", f'{head}<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{RELATION}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        listed = "".join(f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1))
        out.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{MAIN}" xmlns:r="{RELATION}"><sheets>{listed}</sheets></workbook>')
        related = "".join(f'<Relationship Id="rId{i}" Type="{RELATION}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1))
        out.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{PACKAGE}/relationships">{related}</Relationships>')
        for i, df in enumerate(sheets.values(), 1):
            with out.open(f"xl/worksheets/sheet{i}.xml", "w") as part:
                for text in _sheet(df):
                    part.write(text.encode())


def _values(sheet: bytes, shared: list[str]) -> Iterator[list[str | None]]:
    for row in ElementTree.fromstring(sheet).iter(f"{{{MAIN}}}row"):
        out: list[str | None] = []
        for cell in row.iter(f"{{{MAIN}}}c"):
            at = _number(re.match("[A-Z]+", cell.get("r", "A"))[0]) if cell.get("r") else len(out)
            out += [None] * (at + 1 - len(out))
            value = cell.find(f"{{{MAIN}}}v")
            if cell.get("t") == "inlineStr":
                out[at] = "".join(t.text or "" for t in cell.iter(f"{{{MAIN}}}t"))
            elif value is not None and value.text is not None:
                out[at] = shared[int(value.text)] if cell.get("t") == "s" else value.text
        yield out


def read_xlsx(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The sheets of a workbook by name, all columns texts, named by the first row; columns without a heading are
    ``unnamed_`` and their number. A workbook is read on the driver, as a spreadsheet fits there."""
    with zipfile.ZipFile(Path(path)) as book:
        part = lambda name: ElementTree.fromstring(book.read(name))
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{MAIN}}}t")) for si in part("xl/sharedStrings.xml").iter(f"{{{MAIN}}}si")]
        target = {r.get("Id"): r.get("Target").removeprefix("/xl/") for r in part("xl/_rels/workbook.xml.rels")}
        out = {}
        for sheet in part("xl/workbook.xml").iter(f"{{{MAIN}}}sheet"):
            rows = list(_values(book.read("xl/" + target[sheet.get(f"{{{RELATION}}}id")]), shared))
            width = max(map(len, rows), default=0)
            rows = [r + [None] * (width - len(r)) for r in rows]
            names = [c if c else f"unnamed_{i}" for i, c in enumerate(rows[0])] if rows else []
            if names:
                out[sheet.get("name")] = spark.createDataFrame([tuple(r) for r in rows[1:]], ", ".join("`" + n.replace("`", "``") + "` string" for n in names))
    return out
