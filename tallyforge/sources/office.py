"""Word, Excel and text files of a folder as rows, read by Spark's binary files source in tasks.

A DOCX or XLSX file is an archive of XML parts; a task opens one file at a time and streams its parts.
Files larger than a bound are pruned in the scan, before their content is read. A file that can't be
read becomes a row with an error, never a failed job.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a file, and of one unpacked part, beyond which it is not read.
MOST, UNPACKED = 256 << 20, 1 << 30
#: Names of the elements that hold text in both formats (fixed by the file formats).
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _part(archive: zipfile.ZipFile, name: str):
    if archive.getinfo(name).file_size > UNPACKED:
        raise ValueError(f"{name} is larger than {UNPACKED} bytes")
    return archive.open(name)


def docx_text(data: bytes) -> str:
    """Paragraphs of a document, cells of tables among them, a line each; tabs and breaks are kept."""
    lines, line = [], []
    with zipfile.ZipFile(io.BytesIO(data)) as archive, _part(archive, "word/document.xml") as part:
        for _, e in ElementTree.iterparse(part):
            if e.tag == f"{_W}t":
                line.append(e.text or "")
            elif e.tag in (f"{_W}tab", f"{_W}br"):
                line.append("\t" if e.tag.endswith("tab") else "\n")
            elif e.tag == f"{_W}p":
                lines.append("".join(line))
                line = []
                e.clear()
    return "\n".join(x for x in lines if x.strip())


def plain_text(data: bytes) -> str:
    """UTF-8 with or without a mark, else the Cyrillic Windows code page."""
    try:
        return data.decode("utf-8-sig")
    except UnicodeDecodeError:
        return data.decode("cp1251", "replace")


def xlsx_rows(data: bytes) -> Iterator[tuple[str, int, list[str | None]]]:
    """(sheet part, row number, cells by position) of every row that has a cell."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        names, shared = archive.namelist(), []
        if "xl/sharedStrings.xml" in names:
            with _part(archive, "xl/sharedStrings.xml") as part:
                for _, e in ElementTree.iterparse(part):
                    if e.tag == f"{_S}si":
                        shared.append("".join(t.text or "" for t in e.iter(f"{_S}t")))
                        e.clear()
        for name in sorted(n for n in names if re.fullmatch(r"xl/worksheets/[^/]+\.xml", n)):
            with _part(archive, name) as part:
                for _, e in ElementTree.iterparse(part):
                    if e.tag != f"{_S}row":
                        continue
                    cells: list[str | None] = []
                    for c in e.iter(f"{_S}c"):
                        letters = re.match("[A-Z]*", c.get("r") or "").group()
                        at = sum((ord(x) - 64) * 26**k for k, x in enumerate(reversed(letters))) - 1 if letters else len(cells)
                        cells += [None] * (at + 1 - len(cells))
                        value = c.find(f"{_S}v")
                        if c.get("t") == "inlineStr":
                            cells[at] = "".join(t.text or "" for t in c.iter(f"{_S}t"))
                        elif value is not None and value.text is not None:
                            cells[at] = shared[int(value.text)] if c.get("t") == "s" else value.text
                    yield name.rsplit("/", 1)[1].removesuffix(".xml"), int(e.get("r") or 0), cells
                    e.clear()


def _files(spark: SparkSession, path: str, most: int) -> tuple[DataFrame, DataFrame]:
    """Files to read (path, content), and those that are too large (path, length)."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.filter(F.col("length") <= most).select("path", "content"), found.filter(F.col("length") > most).select("path", "length")


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            text = error = None
            try:
                text = docx_text(data.as_py()) if path.lower().endswith(".docx") else plain_text(data.as_py())
            except Exception as e:  # whatever a broken file raises
                error = f"{type(e).__name__}: {e}"
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([text], pa.string()), pa.array([error], pa.string())], names=["path", "text", "error"])


def read_texts(spark: SparkSession, path: str, most: int = MOST) -> DataFrame:
    """(path, text, error) of the DOCX, TXT and MD files of a folder; other files are not looked at, and the
    source lists no files without bytes.
    Files of more than ``most`` bytes are rows with an error."""
    files, large = _files(spark, path, most)
    wanted = F.lower("path").rlike(r"\.(docx|txt|md)$")
    files.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    out = files.filter(wanted).mapInArrow(_texts, "path string, text string, error string")
    return out.unionByName(large.filter(wanted).select("path", F.lit(None).cast("string").alias("text"), F.concat(F.col("length"), F.lit(" bytes: too large")).alias("error")))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [("path", pa.string()), ("sheet", pa.string()), ("row", pa.int64()), ("cells", pa.list_(pa.string())), ("error", pa.string())]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), kinds, strict=True)], names=[n for n, _ in kinds])

    for b in batches:
        for path, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            held: list[tuple] = []
            try:
                for sheet, row, cells in xlsx_rows(data.as_py()):
                    held.append((path, sheet, row, cells, None))
                    if len(held) == 4096:
                        yield batch(held)
                        held = []
            except Exception as e:  # whatever a broken file raises; rows before the fault stay
                held.append((path, None, None, None, f"{type(e).__name__}: {e}"))
            if held:
                yield batch(held)


def read_sheets(spark: SparkSession, path: str, columns: list[str], useful: list[str] | None = None, header: int = 1, most: int = MOST) -> DataFrame:
    """(path, sheet, row, *columns, error): rows of all sheets of the XLSX files of a folder, cells by position.

    Rows up to number ``header`` are left out, and those in which none of the ``useful`` columns (all where
    not given) has more than blanks. Values are strings; missing cells are null. A broken or too large
    file is one row with its error.
    """
    files, large = _files(spark, path, most)
    wanted = F.lower("path").endswith(".xlsx")
    files.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    out = files.filter(wanted).mapInArrow(_rows, "path string, sheet string, row bigint, cells array<string>, error string")
    out = out.unionByName(large.filter(wanted).select("path", F.concat(F.col("length"), F.lit(" bytes: too large")).alias("error")), allowMissingColumns=True)
    out = out.select("path", "sheet", "row", *[F.trim(F.get("cells", i)).alias(c) for i, c in enumerate(columns)], "error")
    some = F.greatest(*[F.coalesce(F.length(c), F.lit(0)) for c in useful or columns], F.lit(0)) > 0
    return out.filter(F.col("error").isNotNull() | ((F.col("row") > header) & some))
