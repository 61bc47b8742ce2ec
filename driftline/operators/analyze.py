"""Analysis of difference rows: routing, hints, prompts, reply parsing, rule fallback, batch calls."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from driftline.functions import fixed
from driftline.functions import text as tx

DIFFS = "array<struct<type:string,impact:string,base_quote:string,compare_quote:string,description:string,workload_hint:string>>"
RESULT = f"struct<diffs:{DIFFS},summary:string>"


def has_side(role: str) -> Column:
    return F.coalesce(F.col(f"{role}_section_id"), F.lit("")) != ""


def route() -> Column:
    """Which prompt a row takes: pair, base_only or compare_only."""
    return F.when(~has_side("compare"), "base_only").when(~has_side("base"), "compare_only").otherwise("pair")


def skipped() -> Column:
    """Pairs without a difference are not analysed."""
    return (route() == "pair") & ~F.coalesce(F.col("has_diff"), F.lit(False))


def hints(rows: DataFrame, key: list[str], text: str = "text", patterns=fixed.HINTS, k: int = 3) -> DataFrame:
    """The ``k`` hints of highest priority with a keyword in each text, joined in their order.

    The pattern list is a constant of the program, so each pattern is one expression: no join at all.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    found = found_hints(F.col(text), patterns)
    return rows.select(*key, tx.let(found, lambda h: F.array_join(F.slice(h, 1, k), "; ")).alias("hints"), F.size(found).cast("long").alias("n_found"))


def found_hints(text: Column, patterns=fixed.HINTS) -> Column:
    """What the patterns (name, keywords, priority and, if there is one, a text) with a keyword in the text say."""
    low = F.lower(F.coalesce(text, F.lit("")))
    order = sorted(range(len(patterns)), key=lambda i: (-patterns[i][2], i))
    said = lambda p: p[3] if len(p) > 3 and p[3] else p[0]
    return F.filter(F.array(*(F.when(tx.contains_any(low, patterns[i][1]), said(patterns[i])) for i in order)).cast("array<string>"), lambda x: x.isNotNull())


#: What is asked of each kind of row.
ASKED = {
    "pair": "Both versions have this section. List every difference in substance between the two texts; ignore wording and layout. For each give type, impact, a quote of each side, a description and a hint on the work it takes.",
    "base_only": "Only the base version has this section. Say what function, design or parameter is gone with it, with its impact, a quote and a hint on the work it takes.",
    "compare_only": "Only the compare version has this section. Answer with type (feature_added, new_design, new_parameter or other) and a description of what is new.",
}


def prompt(doc_limit: int = 3000, patterns=fixed.HINTS, k: int = 3) -> Column:
    """The user message of a row: what is asked of its kind, hints for pairs, and the texts."""
    ask = F.lit(ASKED["pair"])
    for kind in ("base_only", "compare_only"):
        ask = F.when(route() == kind, ASKED[kind]).otherwise(ask)
    whole = F.concat_ws(" ", "base_section_title", "base_content", "compare_section_title", "compare_content")
    hint = tx.let(found_hints(whole, patterns), lambda h: F.when((route() == "pair") & (F.size(h) > 0), F.concat(F.lit("Known about the matter:\n- "), F.array_join(F.slice(h, 1, k), "\n- "), F.lit("\n"))).otherwise(""))
    head = F.concat(ask, F.lit("\n"), hint)
    part = lambda s: F.concat(F.lit(f"## {s} "), F.coalesce(f"{s}_section_number", F.lit("")), F.lit(" "), F.coalesce(f"{s}_section_title", F.lit("")), F.lit("\n"), tx.truncate(F.coalesce(f"{s}_content", F.lit("")), doc_limit), F.lit("\n"))
    return F.concat(head, F.when(has_side("base"), part("base")).otherwise(""), F.when(has_side("compare"), part("compare")).otherwise(""))


def system_prompt(knowledge: list[str]) -> str:
    """The fixed instruction with whatever knowledge there is."""
    ask = "Classify each difference and answer with a JSON object: diffs (type, impact, base_quote, compare_quote, description, workload_hint) and summary."
    return "\n\n".join([ask, *(k.strip() for k in knowledge if k and k.strip())])


def fallback(reason: str) -> Column:
    """The rules' result: removed, added or unknown, by the sides there are."""
    kind, quote = route(), lambda c: F.substring(F.coalesce(c, F.lit("")), 1, 200)
    of = lambda a, b, c: F.when(kind == "base_only", a).when(kind == "compare_only", b).otherwise(c)
    said = lambda texts: of(*(F.lit(texts[r].format(reason=reason)) for r in ("base_only", "compare_only", "pair")))
    diff = F.struct(
        of("feature_removed", "feature_added", "unknow_diff").alias("type"),
        F.lit("中").alias("impact"),
        of(quote("base_content"), F.lit(""), quote("base_content")).alias("base_quote"),
        of(F.lit(""), quote("compare_content"), quote("compare_content")).alias("compare_quote"),
        said(fixed.FALLBACK_DESCRIPTIONS).alias("description"),
        said(fixed.FALLBACK_HINTS).alias("workload_hint"),
    )
    text = said(fixed.FALLBACK_SUMMARIES)
    none = F.from_json(F.lit('{"diffs":[],"summary":"no change"}'), RESULT)
    return F.when(skipped(), none).otherwise(F.struct(F.array(diff).alias("diffs"), text.alias("summary")).cast(RESULT))


def json_end(text: str, start: int = 0) -> int:
    """The place after the object that begins at ``start``, by balanced braces outside strings, or -1."""
    if start >= len(text) or text[start] != "{":
        return -1
    depth, inside, escaped = 0, False, False
    for k in range(start, len(text)):
        c = text[k]
        if inside:
            escaped, inside = c == "\\" and not escaped, not (c == '"' and not escaped)
        elif c == '"':
            inside = True
        elif c in "{}":
            depth += 1 if c == "{" else -1
            if not depth:
                return k + 1
    return -1


def recover_json(reply: str | None) -> str:
    """The JSON object of a reply: from a fenced block, else from its start, else the last that parses,
    else the reply itself."""
    reply = reply or ""
    fence = reply.find("```json")
    if fence >= 0 and (start := reply.find("{", fence)) >= 0 and (end := json_end(reply, start)) > 0:
        return reply[start:end]
    if reply.strip().startswith("{") and (end := json_end(reply)) > 0:
        return reply[:end]
    start = reply.rfind("{")
    while start >= 0:
        end = json_end(reply, start)
        if end > 0:
            try:
                json.loads(reply[start:end])
                return reply[start:end]
            except ValueError:
                pass
        start = reply.rfind("{", 0, start)
    return reply.strip()


@F.pandas_udf(StringType())
def json_of(reply: pd.Series) -> pd.Series:
    return reply.map(recover_json)


def parse_reply(recovered: Column, raw: Column) -> Column:
    """A checked result; without the needed keys no differences and the reply's first 200 characters.

    A compare-only reply ({type, description}) becomes a result with one difference.
    """
    has = lambda k: F.get_json_object(recovered, f"$.{k}").isNotNull()
    one = F.struct(F.array(F.struct(F.get_json_object(recovered, "$.type").alias("type"), F.lit("中").alias("impact"), F.lit("").alias("base_quote"), F.lit("").alias("compare_quote"), F.get_json_object(recovered, "$.description").alias("description"), F.lit("").alias("workload_hint"))).alias("diffs"), F.get_json_object(recovered, "$.description").alias("summary")).cast(RESULT)
    bad = F.struct(F.array().cast(DIFFS).alias("diffs"), F.substring(raw, 1, 200).alias("summary")).cast(RESULT)
    return F.when(has("diffs") & has("summary"), F.from_json(recovered, RESULT)).when(has("type") & has("description"), one).otherwise(bad)


def envelope(reply: Column) -> Column:
    """The text of a completion: a JSON envelope's message, or the joined deltas of an event stream."""
    lines = F.filter(F.transform(F.split(reply, "\n"), F.trim), lambda x: x.startswith("data:") & ~x.contains("[DONE]"))
    deltas = F.transform(lines, lambda x: F.coalesce(F.get_json_object(F.substring(x, 6, 1 << 30), "$.choices[0].delta.content"), F.lit("")))
    return F.when(F.trim(reply).startswith("data:"), F.array_join(deltas, "")).otherwise(F.coalesce(F.get_json_object(reply, "$.choices[0].message.content"), F.lit("")))


class Analyzer(Protocol):
    """Answers one prompt; raises PermanentError where another try is pointless."""

    def __call__(self, system: str, user: str) -> str: ...


class PermanentError(Exception):
    pass


def call_with_breaker(items: Iterator[tuple], analyzer: Analyzer, system: str, concurrency: int = 1, attempts: int = 3, pause: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> Iterator[tuple]:
    """(key, reply, error) for each (key, prompt), in order.

    Failed tries in a row, over all items, open the breaker at max(2 * concurrency, 5); what is left is
    then answered at once with an error.
    """
    failed, limit = 0, max(2 * concurrency, 5)
    for key, user in items:
        reply, error = None, None
        if failed >= limit:
            yield key, None, "熔断开启"
            continue
        for k in range(attempts):
            try:
                reply, error, failed = analyzer(system, user), None, 0
                break
            except Exception as e:  # noqa: BLE001
                failed += 1
                error = f"{type(e).__name__}: {e}"
                if isinstance(e, PermanentError) or failed >= limit:
                    break
                if k + 1 < attempts:
                    sleep(pause * (k + 1))
        yield key, reply, error


def analyze(rows: DataFrame, analyzer: Analyzer | None = None, system: str = "", concurrency: int = 1, reason: str = "offline", patterns=fixed.HINTS) -> DataFrame:
    """``llm_result`` for every row. Without an analyzer, or where it fails, by rules.

    Calls run in ``concurrency`` tasks, each with its own breaker. A retried task calls again, so write
    the result before it is used twice.
    """
    if analyzer is None:
        return rows.withColumn("llm_result", fallback(reason))
    asked = rows.withColumns({"__skip": skipped(), "__prompt": prompt(patterns=patterns)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def feed():
            for batch in batches:
                yield from zip(batch["item_id"], batch["__prompt"])

        for key, reply, error in call_with_breaker(feed(), analyzer, system, concurrency):
            yield pd.DataFrame({"item_id": [key], "reply": [reply], "error": [error]})

    kind = rows.schema["item_id"].dataType.simpleString()
    replies = asked.filter("NOT __skip").select("item_id", "__prompt").repartition(concurrency).mapInPandas(run, f"item_id {kind}, reply string, error string")
    replies = replies.withColumn("parsed", F.when(F.col("reply").isNotNull(), parse_reply(json_of("reply"), F.col("reply"))))
    return rows.join(replies, "item_id", "left").withColumn("llm_result", F.coalesce("parsed", F.when(F.col("error") == "熔断开启", fallback("熔断开启")).otherwise(fallback("no reply")))).drop("reply", "parsed", "error")


def breaker(outcomes: DataFrame, limit: int = 5) -> DataFrame:
    """An ordered stream (run_id, seq, ok) with ``run``, the failures in a row so far, and ``tripped``,
    whether an earlier row had opened the breaker."""
    w = Window.partitionBy("run_id").orderBy("seq")
    streak = outcomes.withColumn("block", F.sum(F.when(F.col("ok"), 1).otherwise(0)).over(w))
    inside = Window.partitionBy("run_id", "block").orderBy("seq")
    run = F.sum(F.when(F.col("ok"), 0).otherwise(1)).over(inside)
    seen = streak.withColumn("run", run)
    before = F.max(F.when(F.col("run") >= limit, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return seen.select("run_id", "seq", "ok", F.col("run").cast("long").alias("run"), (F.coalesce(before, F.lit(0)) == 1).alias("tripped"))
