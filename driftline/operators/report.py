"""Statistics, table of contents, condensed rows and the Markdown report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions import fixed
from driftline.functions import text as tx


def totals(rows: DataFrame) -> DataFrame:
    n = F.coalesce(F.size("llm_result.diffs"), F.lit(0))
    return rows.agg(F.count("*").alias("total_sections"), F.count_if(n > 0).alias("sections_with_diff"), F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("total_diff_items"))


def diffs(rows: DataFrame, *keep: str) -> DataFrame:
    return rows.select(*keep, F.posexplode("llm_result.diffs").alias("pos", "d"))


def by_type(rows: DataFrame) -> DataFrame:
    """(type, label, n), the most frequent first."""
    t = diffs(rows).groupBy(tx.type_tag(F.col("d.type")).alias("type")).agg(F.count("*").alias("n"))
    labels = F.create_map(*(F.lit(x) for kv in fixed.TYPE_LABELS.items() for x in kv))
    return t.select("type", F.coalesce(F.element_at(labels, F.col("type")), F.col("type")).alias("label"), "n").orderBy(F.desc("n"), "type")


def by_impact(rows: DataFrame) -> DataFrame:
    """(impact, n); the three usual ones are there even if 0, any other that occurs too."""
    seen = diffs(rows).select(F.coalesce("d.impact", F.lit("中")).alias("impact"), F.lit(1).alias("n"))
    zero = rows.sparkSession.createDataFrame([(x, 0) for x in fixed.IMPACTS], "impact string, n int")
    return seen.union(zero).groupBy("impact").agg(F.sum("n").alias("n"))


def toc(rows: DataFrame) -> DataFrame:
    """Numbers of the rows with differences, in order, with the title that the report shows."""
    w = Window.partitionBy("pair_id").orderBy("item_id")
    title = F.when(F.coalesce("base_section_title", F.lit("")) != "", F.col("base_section_title")).otherwise(F.coalesce("compare_section_title", F.lit("")))
    some = rows.filter(F.size("llm_result.diffs") > 0)
    return some.select("pair_id", "item_id", F.row_number().over(w).cast("long").alias("number"), title.alias("title"), F.size("llm_result.diffs").cast("long").alias("n_diffs"))


def details(rows: DataFrame, base: str = "base", compare: str = "compare") -> DataFrame:
    """One row for each difference: sequence tag, locations, quotes, type, impact, description."""
    number = toc(rows).select("pair_id", "item_id", "number")
    loc = lambda s, doc, title: tx.location(F.lit(doc), F.col(f"{s}_section_id"), F.coalesce(f"{s}_section_number", F.lit("")), F.coalesce(f"{s}_page", F.lit("")), title)
    df = rows.join(number, ["pair_id", "item_id"]).select("pair_id", "item_id", "number", loc("base", base, "Base").alias("base_loc"), loc("compare", compare, "Compare").alias("compare_loc"), F.posexplode("llm_result.diffs").alias("pos", "d"))
    return df.select("pair_id", "item_id", "pos", F.format_string("D-%03d", "number").alias("seq"), "base_loc", "compare_loc", tx.type_tag(F.col("d.type")).alias("type"), F.col("d.impact").alias("impact"), tx.quote(F.col("d.base_quote")).alias("base_quote"), tx.quote(F.col("d.compare_quote")).alias("compare_quote"), F.col("d.description").alias("description"))


def condense(rows: DataFrame, quote_chars: int = 150) -> DataFrame:
    """One text block for each difference, with dimension, type, impact, place and short quotes."""
    said = F.array_join(F.transform("llm_result.diffs", lambda d: F.coalesce(d["description"], F.lit(""))), " ")
    cut = lambda c, n: F.substring(F.coalesce(c, F.lit("")), 1, n)
    dim = tx.dimension(F.concat_ws(" ", "base_section_title", "compare_section_title", cut("base_content", 300), cut("compare_content", 300), said))
    shown = lambda c: F.when(cut(c, quote_chars) == "", "(无)").when(F.length(c) > quote_chars, F.concat(F.rtrim(cut(c, quote_chars)), F.lit(" ..."))).otherwise(F.col(c))

    def place(side: str, name: str):
        number = F.when(F.coalesce(f"{side}_section_number", F.lit("")) != "", F.col(f"{side}_section_number")).otherwise(F.col(f"{side}_section_title"))
        page = F.when(F.coalesce(f"{side}_page", F.lit("")) != "", F.concat(F.lit(" P"), f"{side}_page")).otherwise("")
        return F.when(F.coalesce(f"{side}_section_title", F.lit("")) != "", F.concat(F.lit(name + " "), number, page))

    loc = F.concat_ws(" / ", place("base", "Base"), place("compare", "Compare"))
    df = rows.select("pair_id", "item_id", dim.alias("dim"), F.when(loc == "", "—").otherwise(loc).alias("loc"), shown("base_content").alias("bq"), shown("compare_content").alias("cq"), F.posexplode("llm_result.diffs").alias("pos", "d"))
    block = F.concat(F.lit("### ["), F.col("item_id").cast("string"), F.lit("] "), "dim", F.lit(" | "), F.coalesce("d.type", F.lit("")), F.lit(" | 影响:"), F.lower(F.coalesce("d.impact", F.lit(""))), F.lit(" | "), "loc", F.lit("\n差异描述: "), F.coalesce("d.description", F.lit("")), F.lit("\nBase 原文: "), "bq", F.lit("\nCompare 原文: "), "cq")
    return df.select("pair_id", "item_id", "pos", block.alias("block"))


def render(rows: DataFrame, base: str, compare: str, created: str) -> str:
    """The Markdown report of one comparison; its rows come to the driver, as they go into one text."""
    t = totals(rows).first()
    out = [f"# {base} vs {compare}", "", f"- {created}", f"- {t.total_sections} / {t.sections_with_diff} / {t.total_diff_items}", "", "| type | n |", "|---|---|"]
    out += [f"| {r.label} | {r.n} |" for r in by_type(rows).collect()]
    out += ["", "| impact | n |", "|---|---|"]
    out += [f"| {r.impact} | {r.n} |" for r in by_impact(rows).orderBy("impact").collect()]
    out += ["", "## 目录", ""] + [f"{r.number}. {r.title}" for r in toc(rows).orderBy("pair_id", "number").toLocalIterator()] + [""]
    for d in details(rows, base, compare).orderBy("pair_id", "item_id", "pos").toLocalIterator():
        out += [f"### {d.seq} {d.type} ({d.impact})", "", f"- {d.base_loc}", f"  > {d.base_quote}", f"- {d.compare_loc}", f"  > {d.compare_quote}", "", d.description or "", ""]
    return "\n".join(out)


def abstract(rows: DataFrame, call=None, prompt_head: str = "Summarise the cost of these differences.") -> str:
    """A short summary: by ``call`` on the condensed rows, else by counts."""
    if call is None:
        t, impact = totals(rows).first(), {r.impact: r.n for r in by_impact(rows).collect()}
        return f"{t.total_diff_items} differences in {t.sections_with_diff} of {t.total_sections} sections; " + ", ".join(f"{k} {impact[k]}" for k in sorted(impact))
    blocks = [r.block for r in condense(rows).orderBy("pair_id", "item_id", "pos").toLocalIterator()]
    return call(prompt_head + "\n\n" + "\n\n".join(blocks)) if blocks else "No differences."
