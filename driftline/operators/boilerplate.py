"""Boilerplate: sections that hold no subject matter, and rows about them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions import fixed
from driftline.functions import text as tx


@dataclass(frozen=True)
class Boilerplate:
    enabled: bool = False
    titles: tuple[str, ...] = fixed.TITLE_BLACKLIST
    signals: tuple[str, ...] = fixed.CONTENT_SIGNALS
    toc: tuple[str, ...] = fixed.TOC_PATTERNS
    extra: tuple[str, ...] = ()
    skip_front_pages: int = 0
    skip_back_pages: int = 0


def title_hit(title: Column, cfg: Boilerplate) -> Column:
    return tx.contains_any(F.coalesce(title, F.lit("")), cfg.titles)


def content_hit(title: Column, content: Column, cfg: Boilerplate) -> Column:
    text = F.coalesce(content, F.lit(""))
    out = tx.contains_any(text, cfg.signals)
    for p in cfg.toc:
        out = out | text.rlike(p)
    if cfg.extra:
        out = out | tx.contains_any(F.concat_ws(" ", title, content), cfg.extra)
    return out


def is_boilerplate(title: Column, content: Column, cfg: Boilerplate) -> Column:
    """A listed word in the title, or a signal, a table of contents or an extra word in the content."""
    return title_hit(title, cfg) | content_hit(title, content, cfg)


def dropped(cfg: Boilerplate, last_page: Column | None = None) -> Column:
    """Whether a difference row goes: by the sides that have a title, or by the pages at either end."""
    b, c = F.coalesce("base_section_title", F.lit("")), F.coalesce("compare_section_title", F.lit(""))
    base, compare = (is_boilerplate(F.col(f"{s}_section_title"), F.col(f"{s}_content"), cfg) for s in ("base", "compare"))
    out = F.when((b != "") & (c != ""), base | compare).when(c == "", base).otherwise(compare)
    for side in ("base_page", "compare_page"):
        page = F.expr(f"coalesce(try_cast({side} AS int), 0)")
        near = page <= cfg.skip_front_pages
        if cfg.skip_back_pages and last_page is not None:
            near = near | (page >= last_page - cfg.skip_back_pages + 1)
        out = out | ((page > 0) & near)
    return out


def filter_items(items: DataFrame, cfg: Boilerplate) -> DataFrame:
    """Difference rows without boilerplate; all of them if the filter is off."""
    if not cfg.enabled:
        return items
    if not cfg.skip_back_pages:
        return items.filter(~dropped(cfg))
    last = items.agg(F.coalesce(F.max(F.greatest(*(F.expr(f"coalesce(try_cast({s} AS int), 0)") for s in ("base_page", "compare_page")))), F.lit(0)).alias("__last"))
    return items.crossJoin(F.broadcast(last)).filter(~dropped(cfg, F.col("__last"))).drop("__last")  # one row


def filter_sections(secs: DataFrame, cfg: Boilerplate) -> DataFrame:
    """Sections without boilerplate, before they are aligned."""
    return secs.filter(~is_boilerplate(F.col("title"), F.col("content"), cfg)) if cfg.enabled else secs


def counts(items: DataFrame, cfg: Boilerplate) -> DataFrame:
    """total, title_hits, content_hits and either, over rows with base and compare titles and contents."""
    t = title_hit(F.col("base_section_title"), cfg) | title_hit(F.col("compare_section_title"), cfg)
    c = content_hit(F.col("base_section_title"), F.col("base_content"), cfg) | content_hit(F.col("compare_section_title"), F.col("compare_content"), cfg)
    return items.agg(F.count("*").alias("total"), F.count_if(t).alias("title_hits"), F.count_if(c).alias("content_hits"), F.count_if(t | c).alias("either"))
