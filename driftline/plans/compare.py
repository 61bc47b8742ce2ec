"""One plan for any number of comparisons, its configuration and command line."""

from __future__ import annotations

import argparse
import datetime
import importlib
import logging
import os
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions import fixed
from driftline.functions.durable import durable
from driftline.operators import align, analyze, boilerplate, client, cluster, report, sections, textdiff
from driftline.sources import files

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Config:
    similarity_threshold: float = 0.25
    min_change_chars: int = 30
    stored_chars: int = 500
    granularity: str = "char"
    max_items: int | None = None
    cluster_threshold: float | None = 0.88
    concurrency: int = 1
    compat: bool = False
    boilerplate: boilerplate.Boilerplate = field(default_factory=boilerplate.Boilerplate)
    #: Texts for the analyser's system prompt, and hint patterns: name, keywords, priority and a text.
    knowledge: tuple[str, ...] = ()
    patterns: tuple[tuple, ...] = fixed.HINTS

    @classmethod
    def load(cls, path: str | None = None, env=os.environ) -> Config:
        """Defaults, then a YAML file, then DRIFTLINE_* variables.

        A key of the file may stand at its top, inside sections, or be written with dots (``alignment.similarity_threshold``); its
        last part counts. ``boilerplate`` holds that filter's fields, ``knowledge`` and ``patterns`` as ``load_knowledge`` reads them.
        """
        values: dict = {}
        if path:
            import yaml

            with open(path, encoding="utf-8") as f:
                values = yaml.safe_load(f) or {}
        out, known = cls(), {}

        def take(found: dict) -> None:
            for key, value in found.items():
                name = str(key).rsplit(".", 1)[-1]
                if name == "boilerplate":
                    known[name] = replace(out.boilerplate, **{k: tuple(v) if isinstance(v, list) else v for k, v in value.items()})
                elif name in ("knowledge", "patterns"):
                    known["knowledge"], known["patterns"] = load_knowledge({name: value}, known.get("knowledge", out.knowledge), known.get("patterns", out.patterns))
                elif isinstance(value, dict):
                    take(value)
                elif name in cls.__dataclass_fields__:
                    known[name] = value

        take(values)
        for name, kind in (("similarity_threshold", float), ("min_change_chars", int), ("stored_chars", int), ("granularity", str), ("max_items", int), ("cluster_threshold", float), ("concurrency", int), ("compat", lambda v: v.lower() in ("1", "true", "yes"))):
            if (v := env.get(f"DRIFTLINE_{name.upper()}")) is not None:
                known[name] = kind(v)
        return replace(out, **known)


def load_knowledge(values: dict, knowledge=(), patterns=fixed.HINTS) -> tuple[tuple[str, ...], tuple[tuple, ...]]:
    """Texts and patterns of a YAML mapping: ``knowledge`` a text or several, ``patterns`` {name: {keywords, priority, hint}}."""
    said = values.get("knowledge")
    if said is not None:
        knowledge = (said,) if isinstance(said, str) else tuple(said)
    if values.get("patterns") is not None:
        patterns = tuple((name, tuple(p.get("keywords", ())), int(p.get("priority", 0)), p.get("hint", "")) for name, p in values["patterns"].items())
    return knowledge, patterns


def documents_to_sections(lines: DataFrame, role: str, pair: str, compat: bool = False) -> DataFrame:
    found = sections.sections(lines, compat).withColumn("page", F.col("page_num").cast("string"))
    return found.select(F.lit(pair).alias("pair_id") if pair else F.col("doc_id").alias("pair_id"), F.lit(role).alias("role"), "seq", "number", "title", "content", "page")


def compare(secs: DataFrame, cfg: Config = Config(), analyzer: analyze.Analyzer | None = None) -> DataFrame:
    """Analysed difference rows of sections (pair_id, role, seq, number, title, content, page)."""
    secs = boilerplate.filter_sections(secs, cfg.boilerplate)
    matched, _, _ = align.align(secs, cfg.similarity_threshold)
    items = textdiff.diff_items(secs, matched, cfg.min_change_chars, cfg.stored_chars, cfg.granularity)
    items = cluster.ranked(boilerplate.filter_items(items, cfg.boilerplate))
    if cfg.max_items is not None:
        items = items.filter(F.col("item_id") <= cfg.max_items)
    if analyzer is None or cfg.cluster_threshold is None:
        return analyze.analyze(items, analyzer, analyze.system_prompt(list(cfg.knowledge)), cfg.concurrency, patterns=cfg.patterns)
    items = durable(items.withColumn("row_id", F.col("item_id")).withColumn("item_id", F.xxhash64("pair_id", "item_id")).withColumn("text", cluster.item_text()))
    mapped = cluster.clusters(items, cluster.links(items, cfg.cluster_threshold, ("pair_id",)))
    reps = items.join(mapped.filter("is_rep").select("item_id"), "item_id", "left_semi")
    done = durable(analyze.analyze(reps, analyzer, analyze.system_prompt(list(cfg.knowledge)), cfg.concurrency, patterns=cfg.patterns).select("item_id", "llm_result"))
    return cluster.expand(items, mapped, done).drop("item_id", "text", "cluster_id").withColumnRenamed("row_id", "item_id")


@dataclass(frozen=True)
class Pdf:
    """Plug-ins for PDF files: functions from bytes to page texts, and to (page, cells, accuracy) of tables.

    Tables go to the end of a document or, with ``insert``, into the section they belong to.
    """

    text: Callable | None = None
    second_text: Callable | None = None
    tables: Callable | None = None
    second_tables: Callable | None = None
    insert: bool = False

    @classmethod
    def named(cls, module: str) -> Pdf:
        """The functions of a module that have the names of the fields."""
        found = importlib.import_module(module)
        return cls(**{k: getattr(found, k) for k in cls.__dataclass_fields__ if hasattr(found, k)})


def pdf_lines(found: DataFrame, pdf: Pdf) -> DataFrame:
    """Markdown lines of PDF files, with their tables."""
    lines = sections.to_markdown(sections.pages_to_lines(files.pdf_pages(found, pdf.text, pdf.second_text)))
    if pdf.tables is None:
        return lines
    scored = files.pdf_tables(found, pdf.tables)
    tables = durable(files.choose_tables(scored, files.pdf_tables(found, pdf.second_tables) if pdf.second_tables else scored.limit(0)))
    if not pdf.insert:
        return sections.append_tables(lines, tables)
    lines = durable(lines)
    secs = durable(sections.sections(lines))
    return sections.insert_tables(lines, tables, sections.associate_tables(tables, secs), secs)


def read_lines(spark: SparkSession, path: str, pdf: Pdf | None = None, strict: bool = True) -> DataFrame:
    """Markdown lines of the files under a path. Unreadable ones are an error or, if not ``strict``, logged and left out."""
    found = files.read_files(spark, path)
    parts = files.docx(found)
    for r in files.unreadable(found, parts).toLocalIterator():
        if strict:
            raise ValueError(f"{r.doc_id}: {r.error}")
        log.warning("%s left out: %s", r.doc_id, r.error)
    out = files.markdown_lines(found).unionByName(files.docx_lines(parts.filter("kind <> 'e'")))
    if pdf is not None and pdf.text is not None:
        out = out.unionByName(pdf_lines(found, pdf))
    return out


def run(spark: SparkSession, base: str, compares: str, output: str | None = None, cfg: Config = Config(), analyzer=None, pdf: Pdf | None = None, day: str | None = None, summarise=None) -> dict[str, str]:
    """Reports by compare document: one base against every file under ``compares``, in one plan.

    Compare files that can't be read are left out; the others go on. The archive has each comparison's
    sections, analysed rows, condensed rows, report.md and abstract.md. ``summarise`` writes the abstract
    from a prompt; without it counts do.
    """
    day = day or datetime.date.today().strftime("%Y%m%d")
    left, right = read_lines(spark, base, pdf), read_lines(spark, compares, pdf, strict=False)
    pairs = documents_to_sections(right, "compare", "", cfg.compat)
    ids = pairs.select("pair_id").distinct()
    # The base's sections are repeated for each comparison: documents, not rows of data, times documents.
    own = documents_to_sections(left, "base", "base", cfg.compat).drop("pair_id").crossJoin(ids)
    secs = durable(own.unionByName(pairs))
    rows = durable(compare(secs, cfg, analyzer))
    name = base.rstrip("/").rsplit("/", 1)[-1]
    out = {}
    if output:
        # All comparisons at once; a run's folder names its own part.
        root = f"{output}/{day}_{name}".replace(" ", "_")
        for kind, df in (("analysed", rows), ("sections", secs), ("condensed", report.condense(rows))):
            df.write.mode("overwrite").partitionBy("pair_id").parquet(f"{root}/{kind}")
    for r in ids.orderBy("pair_id").toLocalIterator():
        mine = rows.filter(F.col("pair_id") == r.pair_id)
        out[r.pair_id] = report.render(mine, name, r.pair_id, day)
        if output:
            folder = files.run_folder(output, day, name, r.pair_id)
            files.save({"analysed": mine}, folder)
            files.write_text(spark, f"{folder}/report.md", out[r.pair_id])
            files.write_text(spark, f"{folder}/abstract.md", report.abstract(mine, summarise))
    return out


def resume(spark: SparkSession, folder: str) -> str:
    """The report again, from a run's archived rows."""
    rows = files.load(spark, folder, ["analysed"])["analysed"]
    if rows is None:
        raise FileNotFoundError(f"no analysed rows in {folder}")
    return report.render(rows, *files.names_of(folder), datetime.date.today().strftime("%Y%m%d"))


def endpoint(spec: str) -> client.Endpoint:
    """An endpoint of ``URL,MODEL,KEY_VARIABLE,stream``; the key is read from the variable that is named."""
    url, model, key, stream = (spec.split(",") + ["", "", ""])[:4]
    return client.Endpoint(url, model, os.environ.get(key, "") if key else "", stream == "stream")


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="driftline")
    p.add_argument("--base")
    p.add_argument("--compare", help="a file, or a folder or glob for many")
    p.add_argument("--output", default="output")
    p.add_argument("--no-archive", action="store_true")
    p.add_argument("--max-items", type=int)
    p.add_argument("--concurrency", type=int, default=1)
    p.add_argument("--config")
    p.add_argument("--pdf", help="a module with the functions text, second_text, tables, second_tables for PDF files")
    p.add_argument("--endpoint", action="append", default=[], metavar="URL[,MODEL[,KEY_VARIABLE[,stream]]]", help="a chat-completion service for the analysis; repeat it for others to fall back to")
    p.add_argument("--resume")
    p.add_argument("--verbose", action="store_true")
    a = p.parse_args(argv)
    logging.basicConfig(level=logging.DEBUG if a.verbose else logging.INFO)
    spark = SparkSession.builder.appName("driftline").getOrCreate()
    if a.resume:
        print(resume(spark, a.resume))
        return 0
    if not (a.base and a.compare):
        p.error("--base and --compare are needed")
    cfg = replace(Config.load(a.config), concurrency=a.concurrency)
    if a.max_items is not None:
        cfg = replace(cfg, max_items=a.max_items)
    analyzer = client.HttpAnalyzer([endpoint(e) for e in a.endpoint]) if a.endpoint else None
    summarise = (lambda text: analyzer("", text)) if analyzer else None
    for name, text in run(spark, a.base, a.compare, None if a.no_archive else a.output, cfg, analyzer, Pdf.named(a.pdf) if a.pdf else None, summarise=summarise).items():
        log.info("%s", name)
        print(text)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
