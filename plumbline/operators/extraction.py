"""Entities and attributes from the tables on a document's pages.

Input is a row per page table: doc_id, page_num, page_height, table_idx, top, words (array of text, top, bottom),
text_lines, cells (array of rows of texts); pages without tables have table_idx and cells null. Whether a table goes on
from the one before depends on that one's columns, so each document is folded in order; documents are independent.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions import text as tx

# Distance within which words stand in one line, part of a page in which a table may go on, characters
# from which a line is a heading.
LINE, NEAR_TOP, HEADING = 5, 0.35, 15
ENTITIES = "doc_id long, entity_no int, raw_heading string, start_page int, pages array<int>, table_index int, columns array<string>, data_rows array<array<string>>"


def closest_line(words, top: float) -> str | None:
    """The words of the lowest line above a table, left as they come; None if nothing stands there."""
    lines: dict[int, list[str]] = {}
    for w in words if words is not None else ():
        if w["bottom"] <= top:
            lines.setdefault(round(w["top"] / LINE) * LINE, []).append(w["text"])
    return " ".join(lines[max(lines)]).strip() if lines else None


def heading(words, top: float, text_lines) -> str:
    found = closest_line(words, top)
    if found is not None:
        return found
    return text_lines[-1] if text_lines is not None and len(text_lines) else "UnknownEntity"


def _cells(row) -> list[str]:
    return [str(c).strip() if c else "" for c in row]


def _numeric(cell: str) -> bool:
    return re.sub("[-. ]", "", cell).isnumeric()


def header(cells) -> tuple[list[str], list]:
    """(columns, data rows): the first row names the columns unless one of its cells looks like a number."""
    first = _cells(cells[0])
    if any(_numeric(c) for c in first):
        return [f"col_{i}" for i in range(len(first))], list(cells)
    return [c or f"col_{i}" for i, c in enumerate(first)], list(cells[1:])


def goes_on(columns: list[str], cells, words, top: float, height: float) -> tuple[bool, bool]:
    """(whether the table continues one with these columns, whether its first row repeats their names)."""
    first = _cells(cells[0])
    known = {c.lower() for c in columns}
    if len(first) != len(columns) or top > height * NEAR_TOP:
        return False, False
    above = closest_line(words, top)
    if above is not None:
        is_number = above.replace(" ", "").isdigit()
        is_header = all(w.lower() in known for w in above.split())
        if not is_number and not is_header and len(above) > HEADING:
            return False, False
    return True, [c.lower() for c in first] == [c.lower() for c in columns]


def _folded(pages: pd.DataFrame) -> pd.DataFrame:
    out: list[dict] = []
    open_: dict | None = None
    pages = pages.sort_values(["page_num", "table_idx"], na_position="first")
    for page_num, group in pages.groupby("page_num", sort=True):
        tables = [t for t in group.itertuples() if t.cells is not None and len(t.cells)]
        if not tables:
            open_ = None
        for t in tables:
            more, repeated = goes_on(open_["columns"], t.cells, t.words, t.top, t.page_height) if open_ else (False, False)
            if more:
                open_["data_rows"] += [[None if c is None else str(c) for c in r] for r in t.cells[int(repeated) :]]
                open_["pages"].append(int(page_num))
                continue
            columns, rows = header(t.cells)
            open_ = {"doc_id": t.doc_id, "entity_no": len(out) + 1, "raw_heading": heading(t.words, t.top, t.text_lines), "start_page": int(page_num), "pages": [int(page_num)], "table_index": int(t.table_idx), "columns": columns, "data_rows": [[None if c is None else str(c) for c in r] for r in rows]}
            out.append(open_)
    return pd.DataFrame(out, columns=["doc_id", "entity_no", "raw_heading", "start_page", "pages", "table_index", "columns", "data_rows"])


def page_range(pages: DataFrame, wanted: str | None) -> DataFrame:
    """Pages a-b; anything else that isn't a range means all."""
    found = re.fullmatch(r"\s*(\d+)\s*-\s*(\d+)\s*", wanted or "")
    if not found or int(found[1]) > int(found[2]):
        return pages
    return pages.filter(F.col("page_num").between(int(found[1]), int(found[2])))


def entities(pages: DataFrame, wanted_pages: str | None = None) -> DataFrame:
    """A row per entity: doc_id, entity_no, entity, raw_heading, start_page, pages, table_index, columns, data_rows.

    A name that its document already has gets its page and table. A document is folded in one task, in memory."""
    found = page_range(pages, wanted_pages).groupBy("doc_id").applyInPandas(_folded, ENTITIES)
    base = tx.pascal("raw_heading")
    again = F.row_number().over(Window.partitionBy("doc_id", "base").orderBy("entity_no")) > 1
    found = found.withColumn("base", base).withColumn("again", again)
    name = F.when(F.col("again"), F.format_string("%s_P%dT%d", "base", "start_page", "table_index")).otherwise(F.col("base"))
    return found.withColumn("entity", name).drop("base", "again")


def parse_attributes(answer: str | None, columns: list[str]) -> list[tuple[str, str]]:
    """Attributes from a model's answer: JSON, else the first list in it, else the columns without descriptions."""
    for text in (answer or "", *(m.group(0) for m in [re.search(r"\[.*?\]", answer or "", re.DOTALL)] if m)):
        try:
            got = json.loads(text)
            return [(str(x["attribute"]), str(x.get("description", ""))) for x in got]
        except (ValueError, KeyError, TypeError, AttributeError):
            continue
    return [(c, "") for c in columns]


def attributes(found: DataFrame, describe: Callable[[str, list[str], list[list[str]]], str] | None = None, samples: int = 3) -> DataFrame:
    """A row per entity and attribute: doc_id, entity, raw_heading, pages_label, attribute, description.

    describe: asks a model about an entity's name, columns and first rows; without it descriptions are empty."""
    label = tx.page_label(F.array_sort(F.array_distinct("pages")))
    found = found.withColumn("pages_label", label)
    if describe is None:
        rows = F.transform("columns", lambda c: F.struct(c.alias("attribute"), F.lit("").alias("description")))
        return found.select("doc_id", "entity_no", "entity", "raw_heading", "pages_label", F.inline(rows))

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for e in b.itertuples():
                columns, data = list(e.columns), [list(r) for r in e.data_rows[:samples]]
                for name, text in parse_attributes(describe(e.entity, columns, data), columns):
                    rows.append((e.doc_id, e.entity_no, e.entity, e.raw_heading, e.pages_label, name, text))
            yield pd.DataFrame(rows, columns=["doc_id", "entity_no", "entity", "raw_heading", "pages_label", "attribute", "description"])

    return found.select("doc_id", "entity_no", "entity", "raw_heading", "pages_label", F.col("columns"), "data_rows").mapInPandas(ask, "doc_id long, entity_no int, entity string, raw_heading string, pages_label string, attribute string, description string")


def read_pdf_tables(spark: SparkSession, path: str) -> DataFrame:
    """Page tables of PDF files, a task per file, where the reader's library is installed on the executors."""
    schema = "doc_id long, page_num int, page_height double, table_idx int, top double, words array<struct<text:string,top:double,bottom:double>>, text_lines array<string>, cells array<array<string>>"

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        import pdfplumber

        for b in batches:
            rows = []
            for doc_id, content in zip(b["doc_id"], b["content"]):
                with pdfplumber.open(io.BytesIO(content)) as pdf:
                    for n, page in enumerate(pdf.pages, 1):
                        words = [{"text": w["text"], "top": float(w["top"]), "bottom": float(w["bottom"])} for w in page.extract_words() or []]
                        lines = [x.strip() for x in (page.extract_text() or "").split("\n") if x.strip()]
                        tables = list(zip(page.extract_tables(), page.find_tables()))
                        for i, (cells, where) in enumerate(tables or [(None, None)], 1):
                            rows.append((doc_id, n, float(page.height), i if cells else None, float(where.bbox[1]) if where else None, words, lines, cells))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in "doc_id,page_num,page_height,table_idx,top,words,text_lines,cells".split(",")])

    files = spark.read.format("binaryFile").load(path).select(F.xxhash64("path").alias("doc_id"), "content")
    return files.mapInPandas(read, schema)
