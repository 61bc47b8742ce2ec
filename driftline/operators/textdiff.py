"""Text differences as arrays of operations, and what is derived from them."""

from __future__ import annotations

import difflib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from driftline.functions import text as tx

OPS = ArrayType(StructType().add("type", StringType()).add("text", StringType()))


def _clean(text: str | None) -> str:
    lines = (" ".join(x.replace("\t", " ").split(" ")) for x in (text or "").split("\n"))
    return "\n".join(y for x in lines if (y := " ".join(w for w in x.split(" ") if w)))


def _merged(ops: list[tuple[str, str]], glue: str) -> list[dict]:
    out: list[dict] = []
    for kind, text in ops:
        if not text:
            continue
        if out and out[-1]["type"] == kind:
            out[-1]["text"] += glue + text
        else:
            out.append({"type": kind, "text": text})
    return out


def line_ops(a: str | None, b: str | None) -> list[dict]:
    """Operations on whole lines of the cleaned texts; a replacement is a deletion and an insertion."""
    x, y = _clean(a).splitlines(), _clean(b).splitlines()
    ops = []
    for tag, i, j, k, m in difflib.SequenceMatcher(None, x, y, autojunk=False).get_opcodes():
        if tag == "equal":
            ops.append(("equal", "\n".join(x[i:j])))
        else:
            ops += [("delete", "\n".join(x[i:j])), ("insert", "\n".join(y[k:m]))]
    return _merged(ops, "\n")


#: Below so many characters on both sides together, steps are single numbers; above, arrays. Both take the same path.
ARRAYS = 400


def _middle(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int, int]:
    """The middle run of equal characters of a shortest edit path: where it starts and ends in a and b.

    Greedy furthest-reaching paths from both ends, one edit more at a time, until they meet on a diagonal;
    memory is linear in the lengths.
    """
    n, m = len(a), len(b)
    off, delta, none = n + m + 2, n - m, -(1 << 40)
    ends = ((a, b), (a[::-1], b[::-1]))
    reach = [np.full(2 * off + 1, none), np.full(2 * off + 1, none)]
    reach[0][off + 1] = reach[1][off + 1] = 0
    for d in range((n + m + 1) // 2 + 1):
        k = np.arange(-(d - 2 * max(0, d - m)), d - 2 * max(0, d - n) + 1, 2)
        for way in (0, 1):
            p, q = ends[way]
            v, other = reach[way], reach[1 - way]
            x = np.maximum(v[off + k - 1] + 1, v[off + k + 1])
            y = x - k
            bad = (x > n) | (y > m) | (x < 0) | (y < 0)
            x = np.where(bad, none, x)
            start = x.copy()
            on = np.flatnonzero(~bad)
            while len(on):
                i = x[on]
                j = i - k[on]
                go = (i < n) & (j < m)
                on, i, j = on[go], i[go], j[go]
                on = on[p[i] == q[j]]
                x[on] += 1
            v[off + k] = x
            if (delta % 2 == 1) == (way == 0):
                mirror = other[off + delta - k]
                met = np.flatnonzero((x >= 0) & (mirror >= 0) & (x + mirror >= n))
                if len(met):
                    j = met[0]
                    u, w, g = int(start[j]), int(x[j]), int(k[j])
                    return (u, u - g, w, w - g) if way == 0 else (n - w, m - w + g, n - u, m - u + g)
    raise AssertionError("paths from both ends meet")


def _middle_small(a: list[int], b: list[int]) -> tuple[int, int, int, int]:
    """``_middle`` in single numbers."""
    n, m = len(a), len(b)
    off, delta, none = n + m + 2, n - m, -(1 << 40)
    ends = ((a, b), (a[::-1], b[::-1]))
    reach = [[none] * (2 * off + 1), [none] * (2 * off + 1)]
    reach[0][off + 1] = reach[1][off + 1] = 0
    for d in range((n + m + 1) // 2 + 1):
        low, high = -(d - 2 * max(0, d - m)), d - 2 * max(0, d - n)
        for way in (0, 1):
            p, q = ends[way]
            v, other = reach[way], reach[1 - way]
            met, new = None, []
            for k in range(low, high + 1, 2):
                x = max(v[off + k - 1] + 1, v[off + k + 1])
                if x > n or x - k > m or x < 0 or x < k:
                    new.append(none)
                    continue
                u = x
                while x < n and x - k < m and p[x] == q[x - k]:
                    x += 1
                new.append(x)
                if met is None and (delta % 2 == 1) == (way == 0):
                    back = other[off + delta - k]
                    if back >= 0 and x + back >= n:
                        met = u, x, k
            if met:
                u, x, k = met
                return (u, u - k, x, x - k) if way == 0 else (n - x, m - x + k, n - u, m - u + k)
            v[off + low : off + high + 1 : 2] = new
    raise AssertionError("paths from both ends meet")


#: Up to so many pairs of characters, a block's longest common subsequence is found by bits, one a pair (64 MB of them).
CELLS = 1 << 29


def _by_bits(a: str, b: str) -> list[tuple[str, str]]:
    """A shortest sequence of edits, by the rows of the table of common subsequences as bits.

    Bit j of row i is 0 where one more character of b adds to the longest common subsequence with a's first i.
    """
    where: dict[str, int] = {}
    for j, c in enumerate(b):
        where[c] = where.get(c, 0) | 1 << j
    full = (1 << len(b)) - 1
    row, rows = full, [full]
    for c in a:
        if c in where:
            on = row & where[c]
            row = ((row + on) | (row - on)) & full
        rows.append(row)
    i, j, out = len(a), len(b), []
    while i and j:
        end = j
        while j and rows[i] >> (j - 1) & 1:
            j -= 1
        if j < end:
            out.append(("insert", b[j:end]))
        if not j:
            break
        end = i
        while not rows[i - 1] >> (j - 1) & 1:
            i -= 1
        if i < end:
            out.append(("delete", a[i:end]))
        end = i
        while i and j and not rows[i] >> (j - 1) & 1 and rows[i - 1] >> (j - 1) & 1:
            i, j = i - 1, j - 1
        out.append(("equal", a[i:end]))
    out += [("insert", b[:j]), ("delete", a[:i])]
    return out[::-1]


def shortest_edits(a: str, b: str) -> list[tuple[str, str]]:
    """A shortest sequence of deletions and insertions of characters: by bits or, where those are too many, by divide and conquer in linear space."""
    out: list[tuple[str, str]] = []
    todo = [(0, len(a), 0, len(b))]
    points = lambda s: np.frombuffer(s.encode("utf-32-le", "surrogatepass"), "<u4")
    x, y = points(a), points(b)
    while todo:
        i, j, k, m = todo.pop()
        if j < 0:
            out.append(("equal", a[i:-j]))
            continue
        same = 0
        while i + same < j and k + same < m and a[i + same] == b[k + same]:
            same += 1
        if same:
            out.append(("equal", a[i : i + same]))
            i, k = i + same, k + same
        tail = 0
        while i < j - tail and k < m - tail and a[j - tail - 1] == b[m - tail - 1]:
            tail += 1
        if tail:
            todo.append((j - tail, -j, 0, 0))
            j, m = j - tail, m - tail
        if i == j or k == m:
            out += [("delete", a[i:j]), ("insert", b[k:m])]
            continue
        if (j - i) * (m - k) <= CELLS:
            out += _by_bits(a[i:j], b[k:m])
            continue
        u, v, w, z = _middle(x[i:j], y[k:m]) if j - i + m - k > ARRAYS else _middle_small(x[i:j].tolist(), y[k:m].tolist())
        todo.append((i + w, j, k + z, m))
        if w > u:
            todo.append((i + u, -(i + w), 0, 0))
        todo.append((i, i + u, k, k + v))
    return out


def cleaned(ops: list[dict]) -> list[dict]:
    """Without coincidences: an equality no longer than the changes on either side of it becomes part of them."""
    size = lambda block: max(len(block[0]), len(block[1]))
    # Changes as (deleted, inserted) around equalities; a stack, so that a merged change is compared again.
    changes, equals = [["", ""]], []
    for op in ops:
        if op["type"] == "equal":
            equals.append(op["text"])
            changes.append(["", ""])
        else:
            changes[-1][op["type"] == "insert"] += op["text"]
    left, kept = [changes[0]], []
    for text, after in zip(equals, changes[1:]):
        kept.append(text)
        left.append(after)
        while kept and (kept[-1] == "" or (min(size(left[-2]), size(left[-1])) >= len(kept[-1]) > 0)):
            right, mid, before = left.pop(), kept.pop(), left.pop()
            left.append([before[0] + mid + right[0], before[1] + mid + right[1]])
    out = []
    for k, (gone, new) in enumerate(left):
        out += [("delete", gone), ("insert", new)] + ([("equal", kept[k])] if k < len(kept) else [])
    return _merged(out, "")


def char_ops(a: str | None, b: str | None, cleanup: bool = True) -> list[dict]:
    """Operations on characters: lines first, then words, then characters within replaced words.

    Characters are compared by shortest edits, whatever the length of a block; time grows with its length
    times its changes. With ``cleanup`` chance equalities between longer changes are taken into them.
    Equal and inserted texts together are the cleaned second text, equal and deleted ones the first.
    """
    x, y = _clean(a), _clean(b)
    if x == y:
        return [{"type": "equal", "text": x}] if x else []
    ops: list[tuple[str, str]] = []

    def walk(p: list[str], q: list[str], finer) -> None:
        for tag, i, j, k, m in difflib.SequenceMatcher(None, p, q, autojunk=False).get_opcodes():
            old, new = "".join(p[i:j]), "".join(q[k:m])
            if tag == "equal":
                ops.append(("equal", old))
            elif tag == "replace":
                finer(old, new)
            else:
                ops.extend((("delete", old), ("insert", new)))

    words = lambda s: [w for part in s.split(" ") for w in (part, " ")][:-1]
    chars = lambda s, t: ops.extend(shortest_edits(s, t))
    walk(x.splitlines(True), y.splitlines(True), lambda s, t: walk(words(s), words(t), chars))
    found = _merged(ops, "")
    return cleaned(found) if cleanup else found


@F.pandas_udf(OPS)
def line_diff(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([line_ops(x, y) for x, y in zip(a, b)])


@F.pandas_udf(OPS)
def char_diff(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([char_ops(x, y) for x, y in zip(a, b)])


def changed_chars(ops: Column, kind: str | None = None) -> Column:
    """Characters of the operations of one kind, or of all that are no equality."""
    some = F.filter(ops, lambda o: o["type"] != "equal" if kind is None else o["type"] == kind)
    return F.aggregate(some, F.lit(0).cast("long"), lambda n, o: n + F.length(o["text"]))


def significant(ops: Column, threshold: int = 50) -> Column:
    return changed_chars(ops) >= threshold


def snippet(ops: Column, max_context: int = 200) -> Column:
    def show(o: Column) -> Column:
        same = F.when(F.length(o["text"]) > max_context, F.concat(F.substring(o["text"], 1, max_context), F.lit(" ..."))).otherwise(o["text"])
        return F.when(o["type"] == "equal", same).when(o["type"] == "delete", F.concat(F.lit("~~"), o["text"], F.lit("~~"))).otherwise(F.concat(F.lit("**+"), o["text"], F.lit("**")))

    return F.array_join(F.transform(ops, show), "")


def summary_of(gone: Column, new: Column) -> Column:
    return (
        F.when((gone > 0) & (new > 0), F.concat(F.lit("变更：删除 "), gone, F.lit(" 字符，新增 "), new, F.lit(" 字符")))
        .when(gone > 0, F.concat(F.lit("删除："), gone, F.lit(" 字符")))
        .when(new > 0, F.concat(F.lit("新增："), new, F.lit(" 字符")))
        .otherwise("无显著变更")
    )


def summary(ops: Column) -> Column:
    return summary_of(changed_chars(ops, "delete"), changed_chars(ops, "insert"))


ONLY_BASE, ONLY_COMPARE = "Base 独有章节", "Compare 独有章节"


def diff_items(secs: DataFrame, matched: DataFrame, min_change_chars: int = 30, stored_chars: int = 500, granularity: str = "char") -> DataFrame:
    """Rows of aligned pairs (unless both are empty), base-only and compare-only sections.

    ``kind`` and the sequence numbers give the order: pairs by similarity, then the others in theirs.
    """
    side = lambda role: secs.filter(F.col("role") == role).select("pair_id", F.col("seq").alias(f"{role}_seq"), F.concat_ws(":", "pair_id", "seq").alias(f"{role}_section_id"), F.coalesce("number", F.lit("")).alias(f"{role}_section_number"), F.coalesce("title", F.lit("")).alias(f"{role}_section_title"), F.coalesce("content", F.lit("")).alias(f"{role}_full"), F.col("page").cast("string").alias(f"{role}_page"))
    base, compare = side("base"), side("compare")
    pairs = matched.join(base, ["pair_id", "base_seq"]).join(compare, ["pair_id", "compare_seq"]).filter("base_full <> '' OR compare_full <> ''")
    ops = (line_diff if granularity == "line" else char_diff)("base_full", "compare_full")
    pairs = pairs.withColumn("ops", ops).withColumn("has_diff", significant(F.col("ops"), min_change_chars))
    pairs = pairs.select("*", F.lit(0).alias("kind"), summary(F.col("ops")).alias("diff_summary"), F.when(F.col("has_diff"), snippet(F.col("ops"))).otherwise("").alias("diff_snippet")).drop("ops", "tfidf_sim", "keyword_score", "method")
    alone = lambda df, key, kind, text: df.join(matched.select("pair_id", key).distinct(), ["pair_id", key], "left_anti").withColumns({"kind": F.lit(kind), "similarity": F.lit(0.0), "has_diff": F.lit(True), "diff_summary": F.lit(text), "diff_snippet": F.lit("")})
    out = pairs.unionByName(alone(base, "base_seq", 1, ONLY_BASE), allowMissingColumns=True).unionByName(alone(compare, "compare_seq", 2, ONLY_COMPARE), allowMissingColumns=True)
    blank = {c: F.coalesce(c, F.lit("")) for r in ("base", "compare") for c in (f"{r}_section_number", f"{r}_section_title")}
    cut = {f"{r}_content": F.substring(F.coalesce(f"{r}_full", F.lit("")), 1, stored_chars) for r in ("base", "compare")}
    return out.withColumns(blank | cut).drop("base_full", "compare_full")


def head(items: DataFrame, n: int) -> DataFrame:
    return items.orderBy("pair_id", "kind", F.desc("similarity"), "base_seq", "compare_seq").limit(n)
