"""Text expressions: cleaning, line classes, headings, keywords, table and quote formatting."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftline.functions import fixed


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def clean_text(text: Column) -> Column:
    """Runs of blanks and tabs become one blank; lines are trimmed and empty ones dropped."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(x, "[ \t]+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, r"(?<=[.!?。！？])\s+"), lambda s: F.trim(s) != "")


def is_running_head(line: Column, patterns=fixed.RUNNING_HEADS) -> Column:
    line = F.trim(line)
    out = F.length(line) < 3
    for p in patterns:
        out = out | line.rlike(p)
    return out


def is_toc_line(line: Column) -> Column:
    return (F.length(F.trim(line)) > 40) & F.trim(line).rlike(fixed.TOC_LINE)


def heading(line: Column, compat: bool = False) -> Column:
    """struct<level, number, title> of a numbered heading, else null."""
    line = F.trim(line)
    out = F.lit(None).cast("struct<level:int,number:string,title:string>")
    for pattern, group, depth in reversed(fixed.HEADINGS):
        first = F.regexp_extract(line, pattern, 1)
        level = first.cast("int") if compat and depth > 1 else F.lit(depth)
        number = F.trim(F.regexp_extract(line, r"^(?:(?i:annex|appendix)\s+)?([A-Za-z0-9.-]*[A-Za-z0-9])", 1))
        found = F.struct(level.alias("level"), number.alias("number"), F.trim(F.regexp_extract(line, pattern, group)).alias("title"))
        out = F.when(line.rlike(pattern), found).otherwise(out)
    # A line of contents is no heading.
    return out if compat else F.when(~is_toc_line(line), out)


def numbered_title(text: Column) -> Column:
    """struct<level, title> of a word-processor paragraph that reads like a numbered title, else null."""
    text = F.trim(text)
    out = F.lit(None).cast("struct<level:int,title:string>")
    for k, (pattern, group) in reversed(list(enumerate(fixed.NUMBERED_TITLES))):
        depth = F.size(F.split(F.regexp_extract(text, pattern, 1), r"\.")) if k == 0 else F.lit(1)
        out = F.when(text.rlike(pattern), F.struct(depth.alias("level"), F.trim(F.regexp_extract(text, pattern, group)).alias("title"))).otherwise(out)
    return out


def style_level(style: Column) -> Column:
    """Heading level of a paragraph style: exact name, then prefix; 0 means skip, null no heading."""
    s = F.lower(F.trim(style))
    out = F.lit(None).cast("int")
    for name, level in reversed(fixed.STYLES.items()):
        out = F.when(s.startswith(name), level).otherwise(out)
    for name, level in fixed.STYLES.items():
        out = F.when(s == name, level).otherwise(out)
    return out


def keyword_set(text: Column, keywords=fixed.KEYWORDS) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("|".join(keywords)), F.lit(0)))


def keyword_score(a: Column, b: Column) -> Column:
    """Half the Jaccard similarity of two keyword sets, 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.round(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)) * 0.5, 4)).otherwise(F.lit(0.0))


def contains_any(text: Column, words) -> Column:
    return F.lower(text).rlike("|".join(re.escape(w.lower()) for w in words)) if words else F.lit(False)


def truncate(text: Column, limit: int, notice: str = fixed.CUT_NOTICE) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(notice))).otherwise(text)


def table_markdown(cells: Column) -> Column:
    """A Markdown table of array<array<string>>; line breaks become blanks, no rows the empty text."""
    row = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda c: F.trim(F.translate(F.coalesce(c, F.lit("")), "\n", " "))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(cells[0], lambda _: F.lit("---")), " | "), F.lit(" |"))
    return F.when(F.size(cells) > 0, F.array_join(F.concat(F.array(row(cells[0]), rule), F.transform(F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(0))), row)), "\n")).otherwise("")


def page_marker(text: Column) -> Column:
    """The page named by the first marker of a text, or the empty text."""
    return F.regexp_extract(text, r"<!--\s*(?:table_)?page\s*[=: ]\s*(\d+)\s*-->", 1)


def quote(text: Column, limit: int = 300) -> Column:
    cut = F.substring(F.translate(F.coalesce(text, F.lit("")), "\n", " "), 1, limit)
    return F.when(cut == "", fixed.NO_QUOTE).otherwise(cut)


def location(doc: Column, section_id: Column, number: Column, page: Column, side: str) -> Column:
    named = F.concat_ws("，", doc, F.when(number != "", F.concat(F.lit("第 "), number, F.lit(" 节"))), F.when(page != "", F.concat(F.lit("P"), page)))
    return F.when(section_id.isNull(), f"（{side} 中不存在）").otherwise(named)


def dimension(text: Column) -> Column:
    low = F.lower(text)
    out = F.lit(fixed.NO_DIMENSION)
    for group in reversed(fixed.DIMENSIONS):
        out = F.when(contains_any(low, group), group[-1]).otherwise(out)
    return out


def type_tag(col: Column) -> Column:
    return F.replace(F.coalesce(col, F.lit("unknown")), F.lit("-"), F.lit("_"))
