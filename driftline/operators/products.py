"""Products of sparse vectors, block by block: the heavy part of alignment, outside of Spark's joins.

A task holds one block of each side. Blocks are as many as their rows ask for, so that no task grows
with the input, and a pair of blocks is dealt out by itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block of vectors, and about so many matches go on together as one row.
BLOCK, MATCHES = 8192, 1 << 15


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt out by keys over all shuffle partitions: few bytes may be much work, so these are not put together by their size."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def dealt(left: DataFrame, right: DataFrame, group: list[str], rows: int = BLOCK, weight: str | None = None):
    """Both sides grouped by ``group``, block of the left and block of the right, ready for a cogrouped function.

    Each row goes to all blocks of the other side: to as many as those have ``rows`` rows, or sums of ``weight``.
    """
    size = F.count("*") if weight is None else F.sum(weight)
    number = lambda df, name: df.groupBy(*group).agg(F.ceil(size / rows).cast("int").alias(name))
    both = number(left, "__l").join(number(right, "__r"), group)

    def side(df: DataFrame, own: str, other: str, names: tuple[str, str]) -> DataFrame:
        n = both.select(*group, F.col(own).alias("__own"), F.col(other).alias("__other"))
        out = df.join(n, group).withColumn(names[0], F.pmod(F.xxhash64("id"), F.col("__own")).cast("int"))
        out = out.withColumn(names[1], F.explode(F.sequence(F.lit(0), F.col("__other") - 1))).drop("__own", "__other")
        # Columns of its own, as both sides may come from one frame.
        return spread(out.select(*(F.col(c).alias(c) for c in out.columns)), *group, "__i", "__j").groupBy(*group, "__i", "__j")

    return side(left, "__l", "__r", ("__i", "__j")).cogroup(side(right, "__r", "__l", ("__j", "__i")))


def _lists(table: pa.Table, name: str) -> tuple[np.ndarray, pa.Array]:
    """The row of each element of a list column, and the elements."""
    lists = table.column(name).combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], lists.type)
    n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(n)), n), lists.flatten()


def half_up(x: float) -> float:
    """Four decimals, as SQL rounds."""
    return float(Decimal(repr(x)).quantize(Decimal("0.0001"), ROUND_HALF_UP))


def rounded(x: np.ndarray) -> np.ndarray:
    """Four decimals, of many numbers that are no ties."""
    return np.floor(x * 1e4 + 0.5) / 1e4


def keyword_score(a: tuple, b: tuple) -> float:
    """As ``text.keyword_score``, of two sets without repetitions."""
    both = len(set(a) & set(b))
    return half_up(both / len(set(a) | set(b)) * 0.5) if both else 0.0


def rows_of(left: pa.Table, right: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each row of ``right`` its place, its products with all of ``left`` and their keyword scores.

    Both have ``v``, a list of terms and weights in the order of terms, and ``k``, a list of keywords.
    """
    (at, found), (to, sought) = _lists(left, "v"), _lists(right, "v")
    terms = pa.concat_arrays([found.field("term"), sought.field("term")]).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    mine, yours = terms[: len(at)], terms[len(at) :]
    order = np.argsort(mine, kind="stable")
    start = np.searchsorted(mine[order], np.arange(terms.max(initial=-1) + 2)).tolist()
    at, w = at[order], found.field("w").to_numpy(zero_copy_only=False)[order]
    u, first = sought.field("w").to_numpy(zero_copy_only=False).tolist(), np.searchsorted(to, np.arange(right.num_rows + 1)).tolist()
    yours = yours.tolist()
    sets: dict[tuple, int] = {}
    kinds = np.array([sets.setdefault(tuple(k or ()), len(sets)) for k in left.column("k").to_pylist()], dtype=np.int64)
    scores: dict[tuple, np.ndarray] = {}
    acc = np.empty(left.num_rows)
    for j, k in enumerate(right.column("k").to_pylist()):
        k = tuple(k or ())
        if k not in scores:
            scores[k] = np.array([keyword_score(x, k) for x in sets])[kinds]
        acc.fill(0.0)
        for x in range(first[j], first[j + 1]):
            b, e = start[yours[x]], start[yours[x] + 1]
            if b < e:
                acc[at[b:e]] += w[b:e] * u[x]
        yield j, acc, scores[k]


def best_of(threshold: float):
    """The best row of the left for each of the right, of equals the one with the smallest id, if it reaches the threshold.

    Similarities are rounded to four decimals before they are compared.
    """

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("id")
        at, to, cos, kw, rank = [], [], [], [], []
        for j, acc, score in rows_of(left, right) if left.num_rows else ():
            sim = rounded(np.minimum(acc + score, 1.0))
            if threshold <= 0:
                sim[(acc <= 0) & (score <= 0)] = -1.0
            i = int(np.argmax(sim))
            if sim[i] >= max(threshold, 0.0):
                at.append(i), to.append(j), cos.append(acc[i]), kw.append(score[i]), rank.append(sim[i])
        n = len(at)
        own = {f"g{i}": pa.array([x.as_py()] * n, x.type) for i, x in enumerate(key[:-2])}
        return pa.table(own | {"base": left.column("id").take(pa.array(at, "int64")), "compare": right.column("id").take(pa.array(to, "int64")), "cosine": pa.array(cos, "float64"), "score": pa.array(kw, "float64"), "rank": pa.array(rank, "float64")})

    return run


def all_of(key, left: pa.Table, right: pa.Table) -> pa.Table:
    """Rows with the ``ids`` of the left, those of some of the right, and which of them meet: (i, j, cosine, score, similarity), rounded.

    Nothing is left to compute where pairs are spread out, as that would be done once for each.
    """
    kinds = [pa.int32(), pa.int32(), *[pa.float64()] * 3]
    names = ["i", "j", "cosine", "score", "similarity"]
    out, held, n, begin = [], [], 0, 0
    many = lambda t: pa.list_(pa.list_(t.schema.field("ids").type.value_type))
    bases, compares = left.column("ids").to_pylist(), right.column("ids").to_pylist()

    def ready(end: int) -> pa.RecordBatch:
        parts = [np.concatenate(x) for x in zip(*held)]
        found = pa.StructArray.from_arrays([pa.array(x, t) for x, t in zip(parts, kinds)], names)
        met = pa.ListArray.from_arrays(pa.array([0, len(found)], "int32"), found)
        own = {f"g{i}": pa.array([x.as_py()], x.type) for i, x in enumerate(key[:-2])}
        return pa.record_batch(own | {"bases": pa.array([bases], many(left)), "compares": pa.array([compares[begin:end]], many(right)), "met": met})

    for j, acc, score in rows_of(left, right) if left.num_rows else ():
        i = np.flatnonzero((acc > 0) | (score > 0))
        held.append((i, np.full(len(i), j - begin), rounded(acc[i]), score[i], rounded(np.minimum(acc[i] + score[i], 1.0))))
        n += len(i)
        if n >= MATCHES or j == right.num_rows - 1:
            if n:
                out.append(ready(j + 1))
            held, n, begin = [], 0, j + 1
    if out:
        return pa.Table.from_batches(out)
    return pa.schema([(f"g{i}", x.type) for i, x in enumerate(key[:-2])] + [("bases", many(left)), ("compares", many(right)), ("met", pa.list_(pa.struct(list(zip(names, kinds)))))]).empty_table()
