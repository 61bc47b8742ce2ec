"""Documents as files: Markdown, DOCX and, by a plug-in, PDF; artifacts out and in again."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions import text as tx

SUFFIXES = (".md", ".docx", ".pdf")
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, suffix, content) of the files under a path."""
    df = spark.read.format("binaryFile").load(path)
    return df.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("doc_id"), F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).alias("suffix"), "content")


def check_suffixes(files: DataFrame) -> DataFrame:
    """The files as they are; other kinds than ``SUFFIXES`` (.doc among them) are an error when read."""
    return files.withColumn("suffix", F.when(F.col("suffix").isin(*SUFFIXES), F.col("suffix")).otherwise(F.raise_error(F.concat(F.lit("no reader for files like "), "doc_id"))))


def markdown_lines(files: DataFrame) -> DataFrame:
    lines = files.filter("suffix = '.md'").select("doc_id", F.posexplode(F.split(F.col("content").cast("string"), "\r?\n")).alias("k", "text"))
    return lines.select("doc_id", (F.col("k") + 1).alias("line_no"), F.lit(None).cast("int").alias("page_num"), "text")


def docx_parts(data: bytes) -> Iterator[tuple[str, int, str, list]]:
    """("p" or "t", position, style, text or cells) of a DOCX body, in order."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    said = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t"))
    for k, e in enumerate(body if body is not None else []):
        if e.tag == f"{_W}p":
            style = e.find(f"{_W}pPr/{_W}pStyle")
            yield "p", k, (style.get(f"{_W}val") or "") if style is not None else "", [[said(e)]]
        elif e.tag == f"{_W}tbl":
            yield "t", k, "", [[said(c) for c in r.iter(f"{_W}tc")] for r in e.iter(f"{_W}tr")]


def docx(files: DataFrame) -> DataFrame:
    """(doc_id, kind, pos, style, cells) of DOCX files; a paragraph is one cell.

    A file that can't be read has one row of kind "e" with the error in ``style``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc, data in zip(batch["doc_id"], batch["content"]):
                try:
                    parts = list(docx_parts(data))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as error:
                    parts = [("e", 0, f"{type(error).__name__}: {error}", [])]
                yield pd.DataFrame([(doc, *part) for part in parts], columns=["doc_id", "kind", "pos", "style", "cells"])

    return files.filter("suffix = '.docx'").select("doc_id", "content").mapInPandas(run, "doc_id string, kind string, pos int, style string, cells array<array<string>>")


def docx_paragraphs(parts: DataFrame) -> DataFrame:
    text = F.trim(F.col("cells")[0][0])
    styled = tx.style_level(F.regexp_replace("style", r"(?i)^heading(\d)$", "heading $1"))
    inferred = tx.numbered_title(text)
    level = F.coalesce(styled, inferred["level"], F.lit(0))
    return parts.filter("kind = 'p'").select("doc_id", F.col("pos").alias("para_num"), "style", level.alias("level"), text.alias("text"), (level > 0).alias("is_title"))


def docx_lines(parts: DataFrame) -> DataFrame:
    """Markdown lines of DOCX parts: headings, paragraphs and, at the end, the tables."""
    from driftline.functions.fixed import RUNNING_HEADS_WORD

    p = docx_paragraphs(parts).filter(~tx.is_running_head(F.col("text"), RUNNING_HEADS_WORD))
    p = p.select("doc_id", F.lit(0).alias("part"), F.col("para_num").alias("pos"), F.lit(0).alias("k"), F.when(F.col("is_title"), F.concat(F.repeat(F.lit("#"), F.least("level", F.lit(6))), F.lit(" "), "text")).otherwise(F.col("text")).alias("text"))
    t = parts.filter("kind = 't'").select("doc_id", F.lit(1).alias("part"), "pos", F.posexplode(F.split(F.concat(F.lit("## Tables\n"), tx.table_markdown(F.col("cells"))), "\n")).alias("k", "text"))
    from pyspark.sql import Window

    order = Window.partitionBy("doc_id").orderBy("part", "pos", "k")
    return p.unionByName(t).select("doc_id", F.row_number().over(order).alias("line_no"), F.lit(None).cast("int").alias("page_num"), "text")


def pdf_pages(files: DataFrame, primary: Callable[[bytes], list[str]] | None = None, second: Callable[[bytes], list[str]] | None = None, least: int = 100) -> DataFrame:
    """(doc_id, page_num, text) by a plug-in text extractor; the second is used for documents of which
    the first gets fewer than ``least`` characters."""
    if primary is None:
        raise RuntimeError("reading PDF needs an extractor: a function from bytes to the texts of the pages")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc, data in zip(batch["doc_id"], batch["content"]):
                pages = primary(data)
                if second and sum(map(len, pages)) < least:
                    pages = second(data)
                yield pd.DataFrame({"doc_id": doc, "page_num": range(1, len(pages) + 1), "text": pages})

    return files.filter("suffix = '.pdf'").select("doc_id", "content").mapInPandas(run, "doc_id string, page_num int, text string")


def pdf_tables(files: DataFrame, extract: Callable[[bytes], list[tuple[int, list[list[str]], float | None]]]) -> DataFrame:
    """(doc_id, page_num, table_index, cells, accuracy) by a plug-in: a function from bytes to (page, cells,
    accuracy or None) of the tables, in order. A document on which it fails has no tables."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc, data in zip(batch["doc_id"], batch["content"]):
                try:
                    found = list(extract(data))
                except Exception:  # noqa: BLE001  whatever the plug-in raises: the caller's second source is used
                    found = []
                yield pd.DataFrame([(doc, page, k, [[c or "" for c in r] for r in cells], accuracy) for k, (page, cells, accuracy) in enumerate(found, 1)], columns=["doc_id", "page_num", "table_index", "cells", "accuracy"])

    return files.filter("suffix = '.pdf'").select("doc_id", "content").mapInPandas(run, "doc_id string, page_num int, table_index int, cells array<array<string>>, accuracy double")


def unreadable(files: DataFrame, parts: DataFrame) -> DataFrame:
    """(doc_id, error) of files of other kinds than ``SUFFIXES`` and of DOCX files that are damaged."""
    other = files.filter(~F.col("suffix").isin(*SUFFIXES)).select("doc_id", F.concat(F.lit("no reader for files like "), "doc_id").alias("error"))
    return other.union(parts.filter("kind = 'e'").select("doc_id", "style"))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A text file under any path that Spark can write."""
    jvm = spark._jvm
    to = jvm.org.apache.hadoop.fs.Path(path)
    out = to.getFileSystem(spark._jsc.hadoopConfiguration()).create(to, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def choose_tables(scored: DataFrame, simple: DataFrame, least_accuracy: float = 80.0) -> DataFrame:
    """Scored tables, flagged if inaccurate but never dropped; simple ones for documents without them."""
    flagged = scored.withColumn("low_accuracy", F.col("accuracy") < least_accuracy)
    rest = simple.join(scored.select("doc_id").distinct(), "doc_id", "left_anti").withColumn("low_accuracy", F.lit(False))
    return flagged.unionByName(rest, allowMissingColumns=True)


def run_folder(root: str, day: str, base: str, compare: str) -> str:
    return f"{root}/{day}_{base}_vs_{compare}".replace(" ", "_")


def save(artifacts: dict[str, DataFrame], folder: str) -> None:
    for name, df in artifacts.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def load(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame | None]:
    """The artifacts of a run; None for those that are not there."""
    out: dict[str, DataFrame | None] = {}
    for name in names:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
        out[name] = spark.read.parquet(f"{folder}/{name}") if there else None
    return out


def names_of(folder: str) -> tuple[str, str]:
    """Base and compare names from a run folder's name."""
    m = re.search(r"\d{8}_(.+)_vs_(.+?)/?$", folder)
    return (m[1], m[2]) if m else ("base", "compare")
