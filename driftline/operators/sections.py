"""Pages, lines, sections and tables of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions import text as tx


def pages_to_lines(pages: DataFrame) -> DataFrame:
    """(doc_id, page_num, line_no, text) of (doc_id, page_num, text): one row for each line, in order."""
    lines = pages.select("doc_id", "page_num", F.posexplode(F.split("text", "\n")).alias("k", "text"))
    order = Window.partitionBy("doc_id").orderBy("page_num", "k")
    return lines.select("doc_id", "page_num", F.row_number().over(order).alias("line_no"), "text")


def classify(lines: DataFrame, min_para_len: int = 20, compat: bool = False) -> DataFrame:
    """``kind`` of each line (drop, toc, heading, paragraph, short) and its heading, if it is one."""
    df = lines.withColumn("heading", tx.heading(F.col("text"), compat))
    kind = F.when(tx.is_running_head(F.col("text")), "drop").when(F.lit(compat) & F.col("heading").isNotNull(), "heading").when(tx.is_toc_line(F.col("text")), "toc").when(F.col("heading").isNotNull(), "heading").when(F.length(F.trim("text")) < min_para_len, "short").otherwise("paragraph")
    return df.withColumn("kind", kind)


def to_markdown(lines: DataFrame, min_para_len: int = 20) -> DataFrame:
    """Markdown lines: headings with hashes and their number, paragraphs long enough; the page is a column."""
    df = classify(lines, min_para_len).filter(F.col("kind").isin("heading", "paragraph"))
    head = F.concat(F.repeat(F.lit("#"), F.least(F.col("heading.level"), F.lit(6))), F.lit(" "), F.col("heading.number"), F.lit(" "), F.col("heading.title"))
    return df.select("doc_id", "line_no", "page_num", F.when(F.col("kind") == "heading", head).otherwise(F.trim("text")).alias("text"))


def page_carry(lines: DataFrame, marker: str = r"^\s*<!--\s*(?:table_)?page[ =]+(\d+)\s*-->\s*$") -> DataFrame:
    """The page of each line, carried forward from marker lines, which go."""
    found = F.when(F.col("text").rlike(marker), F.regexp_extract("text", marker, 1).cast("int"))
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return lines.select("doc_id", "line_no", "text", F.last(found, True).over(w).alias("page_num"), found.isNotNull().alias("__m")).filter("NOT __m").drop("__m")


def sections(lines: DataFrame, compat: bool = False) -> DataFrame:
    """Sections of Markdown lines, with number, title, page, id, span and content.

    A section's content ends at the next heading of its own level or a higher one; in ``compat`` mode
    only at one of the very same level.
    """
    level = F.length(F.regexp_extract("text", r"^(#{1,6})\s+\S", 1))
    df = lines.select("doc_id", "line_no", "page_num", "text", level.alias("level"))
    head = df.filter("level > 0")
    order = Window.partitionBy("doc_id").orderBy("line_no")
    if compat:
        end = F.lead("line_no").over(Window.partitionBy("doc_id", "level").orderBy("line_no"))
    else:
        after = order.rowsBetween(1, Window.unboundedFollowing)
        nexts = [F.min(F.when(F.col("level") <= n, F.col("line_no"))).over(after) for n in range(1, 7)]
        end = F.coalesce(*(F.when(F.col("level") == n, nexts[n - 1]) for n in range(1, 7)))
    raw = F.trim(F.regexp_replace("text", r"^#{1,6}\s+", ""))
    # Any first run of ASCII letters and digits, with dotted parts, counts as the number.
    number = F.regexp_extract(raw, r"^[0-9A-Za-z]+(?:\.[0-9A-Za-z]+)*", 0)
    title = F.expr("substring(__raw, length(__number) + 1)")
    seq = F.row_number().over(order) - 1
    head = head.withColumn("__raw", raw).withColumn("__number", number)
    raw, number = F.col("__raw"), F.col("__number")
    name = F.regexp_replace(number, "[. ]", "_")
    head = head.select("doc_id", seq.alias("seq"), "level", number.alias("number"), F.trim(title).alias("title"), raw.alias("raw"), "page_num", "line_no", F.coalesce(end, F.lit(2147483647)).alias("end_line"), F.when(name != "", name).otherwise(F.concat(F.lit("untitled_"), seq)).alias("id"))
    # A line belongs to the last heading of each level before it that no later one has ended: six at most.
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    last = [F.last(F.when(F.col("level") == n, F.col("line_no")), True).over(upto) for n in range(1, 7)]
    df = df.withColumns({f"__h{n + 1}": x for n, x in enumerate(last)})

    def owner(n: int):
        mine = F.col(f"__h{n}")
        above = F.greatest(F.lit(-1), *(F.coalesce(F.col(f"__h{m}"), F.lit(-1)) for m in range(1, n))) if n > 1 and not compat else F.lit(-1)
        return F.when((mine < F.col("line_no")) & (mine > above), mine)

    body = df.select("doc_id", F.col("line_no").alias("n"), F.col("text").alias("t"), F.explode(F.array_compact(F.array(*(owner(n) for n in range(1, 7))))).alias("line_no"))
    content = body.groupBy("doc_id", "line_no").agg(F.array_sort(F.collect_list(F.struct("n", "t"))).alias("c"))
    text = F.coalesce(F.trim(F.array_join(F.transform("c", lambda x: x["t"]), "\n")), F.lit(""))
    return head.join(content, ["doc_id", "line_no"], "left").select("doc_id", "seq", "id", "level", "number", "title", "raw", "page_num", "line_no", F.when(F.col("end_line") < 2147483647, F.col("end_line")).alias("end_line"), text.alias("content"))


def associate_tables(tables: DataFrame, found: DataFrame) -> DataFrame:
    """The section of each table: of those on its page the last numbered one, else the last; without one
    on its page the nearest by page, the first of equals. Tables without a page have none."""
    t = tables.select("doc_id", "table_index", F.col("page_num").alias("table_page"))
    s = found.select("doc_id", "seq", F.col("page_num").alias("section_page"), (F.col("number") != "").alias("numbered"))
    # The nearest page with sections on either side, then its sections: no pairs beyond two pages a table.
    pages = s.filter("section_page IS NOT NULL").select("doc_id", F.col("section_page").alias("page")).distinct()
    marks = t.filter("table_page IS NOT NULL").select("doc_id", F.col("table_page").alias("page")).distinct()
    both = pages.withColumn("own", F.col("page")).unionByName(marks.withColumn("own", F.lit(None).cast("int")))
    back = Window.partitionBy("doc_id").orderBy("page").rangeBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("doc_id").orderBy("page").rangeBetween(0, Window.unboundedFollowing)
    near = both.select("doc_id", "page", "own", F.max("own").over(back).alias("lo"), F.min("own").over(ahead).alias("hi")).filter("own IS NULL")
    near = near.select("doc_id", F.col("page").alias("table_page"), F.explode(F.array_distinct(F.array("lo", "hi"))).alias("section_page")).filter("section_page IS NOT NULL")
    # What a page gives to tables on it and to others, once a page: its last numbered section or else its last, and its first.
    here = F.max_by("seq", F.struct(F.when(F.col("numbered"), 1).otherwise(0).alias("n"), F.col("seq").alias("s")))
    given = s.filter("section_page IS NOT NULL").groupBy("doc_id", "section_page").agg(here.alias("here"), F.min("seq").alias("there"))
    same = F.col("section_page") == F.col("table_page")
    found = near.join(given, ["doc_id", "section_page"]).withColumn("seq", F.when(same, F.col("here")).otherwise(F.col("there")))
    key = F.struct(F.abs(F.col("section_page") - F.col("table_page")).alias("d"), F.col("seq").alias("s"))
    of = found.groupBy("doc_id", "table_page").agg(F.min_by("seq", key).alias("section_seq"))
    return t.join(of, ["doc_id", "table_page"], "left").select("doc_id", "table_index", "table_page", "section_seq")


def tables_appendix(tables: DataFrame) -> DataFrame:
    """One Markdown block a document with its tables in order: caption, accuracy, page marker, rows."""
    head = F.concat(F.lit("### Table "), F.col("table_index").cast("string"), F.coalesce(F.concat(F.lit(" (accuracy "), F.format_number("accuracy", 1), F.lit("%)")), F.lit("")), F.lit("\n<!-- page "), F.coalesce(F.col("page_num").cast("string"), F.lit("?")), F.lit(" -->\n"))
    blocks = tables.select("doc_id", "table_index", F.concat(head, tx.table_markdown(F.col("cells"))).alias("b"))
    return blocks.groupBy("doc_id").agg(F.concat(F.lit("## Tables\n\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("table_index", "b"))), lambda x: x["b"]), "\n\n")).alias("markdown"))


def append_tables(lines: DataFrame, tables: DataFrame) -> DataFrame:
    """Lines with each document's tables block after its last line."""
    block = tables_appendix(tables).select("doc_id", F.posexplode(F.split("markdown", "\n")).alias("k", "text"))
    every = lines.select("doc_id", F.lit(0).alias("part"), F.col("line_no").alias("k"), "page_num", "text").unionByName(block.select("doc_id", F.lit(1).alias("part"), "k", F.lit(None).cast("int").alias("page_num"), "text"))
    return every.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("part", "k")).alias("line_no"), "page_num", "text")


def insert_tables(lines: DataFrame, tables: DataFrame, placed: DataFrame, found: DataFrame) -> DataFrame:
    """Lines with each table's rows after the last line of its own section."""
    last = found.select("doc_id", F.col("seq").alias("section_seq"), F.coalesce(F.col("end_line") - 1, F.lit(2147483646)).alias("line_no"))
    rows = tables.join(placed.select("doc_id", "table_index", "section_seq"), ["doc_id", "table_index"]).join(last, ["doc_id", "section_seq"])
    extra = rows.select("doc_id", "line_no", "page_num", F.col("table_index").alias("part"), F.posexplode(F.split(tx.table_markdown(F.col("cells")), "\n")).alias("k", "text"))
    every = lines.select("doc_id", "line_no", "page_num", F.lit(-1).alias("part"), F.lit(0).alias("k"), "text").unionByName(extra)
    order = Window.partitionBy("doc_id").orderBy("line_no", "part", "k")
    return every.select("doc_id", F.row_number().over(order).alias("line_no"), "page_num", "text")
