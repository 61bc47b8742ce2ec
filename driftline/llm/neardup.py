"""Near-duplicate classes by ProbMinHash, banding and exact verification.

A document is the weighted set of its shingles of ``WORDS`` normalised words (all its words, if fewer);
a shingle that occurs n times weighs 1 + ln n. Each shingle is a Poisson process whose rate is its
weight; each arrival falls into one of ``REGISTERS`` registers, and a register keeps the shingle that
arrives first. Two documents agree in a register with the probability Jaccard similarity. Arrivals later
than the latest register cannot win, so a shingle stops there.

Registers in bands of ``ROWS`` make bucket keys. Identical word sequences are first folded into one
representative by a digest of 128 bits, so copies never meet in a bucket. In a bucket every text is
compared with its first one, not with all. Where a bucket still holds several components, its largest one
is the main one, and the others' texts (the strays) are compared with a member of the main one drawn for each bucket
and round; what is left after ``DRAWS`` rounds is compared with all of its bucket, strays times texts,
by matrix products of blocks, so that no link is lost. Small buckets list their pairs. Verification
computes the exact probability Jaccard similarity; pairs of ``THRESHOLD`` or more link, and components are
the classes.

Scale: texts are read once; what is shuffled are bands (``BANDS`` numbers a document) and once the
shingle sets, 4 bytes a shingle. Hot keys (copies, buckets, hubs) meet in joins of two plain exchanges,
which adaptive execution splits; aggregations over them are partial first. Recall of banding at 0.8 is
above 0.9999 by 1 - (1 - 0.8^5)^26.

Defined results: every row of the input is a document of its own, whatever its doc_id, under a row number
taken once from a checkpointed scan; so rows that share a doc_id, or have none, are compared by their own
texts. A null or empty text, or one without a word, is a class of its own. A class is named by its smallest
doc_id (null if it has none); of its rows the first of that doc_id is kept. Extra columns are ignored or,
in ``deduplicate``, kept; of rows with the same doc_id and the same text one stays, any if their other columns differ.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.functions.durable import durable
from driftline.llm.arrowio import chunks, map_arrow, raw
from driftline.llm.decontam import _WORD_BYTES
from driftline.operators.graph import components

WORDS = 5
THRESHOLD = 0.8
ROWS = 5
BANDS = 26
REGISTERS = ROWS * BANDS
CHUNK = 1 << 20
#: In buckets of at most FEW texts, pairs are listed. In larger ones strays meet a drawn member in DRAWS
#: rounds; then blocks of about BLOCK texts or BLOCK_MASS shingles are compared, COLUMNS shingles at a time.
FEW = 16
DRAWS = 1
BLOCK = 256
BLOCK_MASS = 200_000
COLUMNS = 4096

_GOLD = np.uint64(0x9E3779B97F4A7C15)
#: An odd base and its inverse modulo 2**64, for hashes of words by sums over their bytes.
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _times_gold(k: int) -> np.uint64:
    return np.uint64(k * int(_GOLD) & (1 << 64) - 1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[:1] = 1
    return np.multiply.accumulate(out)


class Hasher:
    """Word hashes and shingles of several texts at once."""

    def __init__(self) -> None:
        self.up = self.down = np.empty(0, "u8")

    def words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each word and the text it belongs to."""
        sizes = np.array([len(t) + 1 for t in texts])
        data = np.frombuffer(b" ".join(texts).translate(_WORD_BYTES) + b" ", "u1")
        if len(data) + 1 > len(self.up):
            self.up, self.down = _powers(_BASE, len(data) + 1), _powers(_INVERSE, len(data) + 1)
        solid = (data != 32).view("i1")
        edge = np.flatnonzero(np.diff(np.concatenate(([np.int8(0)], solid, [np.int8(0)]))))
        start, end = edge[::2], edge[1::2]
        sums = np.concatenate(([np.uint64(0)], np.cumsum((data + np.uint64(1)) * self.up[: len(data)], dtype="u8")))
        value = (sums[end] - sums[start]) * self.down[start]
        return mix(value + (end - start).astype("u8") * _GOLD), np.searchsorted(np.cumsum(sizes), start, "right")

    def shingles(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sorted (text, shingle) with counts, and two digests of the word sequence of each text."""
        h, row = self.words(texts)
        n = np.bincount(row, minlength=len(texts))
        first = np.cumsum(n) - n
        keys = np.zeros((2, len(texts)), "u8")
        if len(h):
            place = (np.arange(len(h)) - first[row]).astype("u8")
            for k in range(2):
                part = mix(h + mix(place + _times_gold(k + 1)))
                np.add.at(keys[k], row, part)
        # Shingles of texts with at least WORDS words; shorter ones have a single one.
        full = np.flatnonzero(np.arange(len(h)) - first[row] <= n[row] - WORDS)
        s = np.zeros(len(full), "u8")
        for k in range(WORDS):
            s = mix(s * np.uint64(3) + h[full + k])
        short = np.flatnonzero((n > 0) & (n < WORDS))
        rows = np.concatenate((row[full], short))
        s = np.concatenate((s, keys[0][short])) >> np.uint64(32)
        packed = np.sort((rows.astype("u8") << np.uint64(32)) | s)
        at = np.flatnonzero(np.concatenate(([True], packed[1:] != packed[:-1]))) if len(packed) else np.empty(0, "i8")
        count = np.diff(np.append(at, len(packed)))
        return packed[at] >> np.uint64(32), packed[at] & np.uint64(0xFFFFFFFF), count, keys


def weights(count: np.ndarray) -> np.ndarray:
    return 1 + np.log(count)


def signatures(row: np.ndarray, shingle: np.ndarray, weight: np.ndarray, rows: int, registers: int = REGISTERS) -> np.ndarray:
    """The winning shingle of each register, rows x registers."""
    best = np.full(rows * registers, np.inf)
    won = np.zeros(rows * registers, "u8")
    row, key, at = row.astype("i8"), mix(shingle + _GOLD), np.zeros(len(row))
    shingle = shingle.copy()
    limit = np.full(rows, np.inf)
    step = 0
    while len(row):
        step += 1
        r = mix(key + _times_gold(step))
        at = at - np.log(((r >> np.uint64(11)) + 0.5) * 2.0**-53) / weight
        slot = row * registers + (mix(r + _GOLD) % np.uint64(registers)).astype("i8")
        np.minimum.at(best, slot, at)
        win = best[slot] == at
        won[slot[win]] = shingle[win]
        live = np.unique(row)
        limit[live] = best.reshape(rows, registers)[live].max(1)
        on = at < limit[row]
        row, shingle, key, weight, at = row[on], shingle[on], key[on], weight[on], at[on]
    return won.reshape(rows, registers)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """rows x BANDS bucket keys."""
    parts = sig.reshape(len(sig), BANDS, ROWS)
    h = np.tile((np.arange(BANDS, dtype="u8") + np.uint64(1)) * _GOLD, (len(sig), 1))
    for k in range(ROWS):
        h = mix(h + parts[:, :, k] * np.uint64(_BASE))
    return h.view("i8")


def similarity(sa: np.ndarray, wa: np.ndarray, sb: np.ndarray, wb: np.ndarray) -> float:
    """Exact probability Jaccard of two weighted sets with sorted distinct members."""
    both, ia, ib = np.intersect1d(sa, sb, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    xa, xb = wa[ia], wb[ib]
    only_a, only_b = wa.sum() - xa.sum(), wb.sum() - xb.sum()
    # A common member's chance depends on the ratio of its weights alone, times its own weight.
    ratio, group = np.unique(xb / xa, return_inverse=True)
    mass = np.bincount(group, xa)
    total = np.array([only_a + only_b / r + np.maximum(xa, xb / r).sum() for r in ratio])
    return float((mass / total).sum())


_SKETCH = "t long, k1 long, k2 long, n int, bands array<long>, shingles binary, counts binary"


def sketch(documents: DataFrame) -> DataFrame:
    """doc_id, a hash of the text, digests of its words, number of shingles, bucket keys, shingles and counts.

    ``counts`` is empty if every shingle occurs once.
    """
    df = documents.select("doc_id", F.xxhash64("text").alias("t"), raw().alias("__raw"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in chunks(batches, "__raw", CHUNK):
            texts = batch.column("__raw").to_pylist()
            row, shingle, count, keys = hasher.shingles(texts)
            sig = band_keys(signatures(row, shingle, weights(count), len(texts)))
            n = np.bincount(row.astype("i8"), minlength=len(texts))
            cut = np.concatenate(([0], np.cumsum(n)))
            small, often = shingle.astype("<u4"), count.astype("<u4")
            sets = [small[a:b].tobytes() for a, b in zip(cut, cut[1:])]
            counts = [often[a:b].tobytes() if b > a and often[a:b].max() > 1 else b"" for a, b in zip(cut, cut[1:])]
            flat = pa.ListArray.from_arrays(np.arange(len(texts) + 1, dtype="i4") * BANDS, pa.array(sig.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("t"), pa.array(keys[0].view("i8")), pa.array(keys[1].view("i8")), pa.array(n.astype("i4")), flat, pa.array(sets, pa.binary()), pa.array(counts, pa.binary())], ["doc_id", "t", "k1", "k2", "n", "bands", "shingles", "counts"])

    return map_arrow(df, run, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, {_SKETCH}")


def _set(shingles: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    s = np.frombuffer(shingles, "<u4")
    return s, weights(np.frombuffer(counts, "<u4")) if counts else np.ones(len(s))


def verify(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b and other columns) whose exact similarity reaches ``threshold``."""
    side = lambda name: sets.select(F.col("uid").alias(name), F.col("shingles").alias(f"set_{name}"), F.col("counts").alias(f"often_{name}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").select(*pairs.columns, "set_a", "often_a", "set_b", "often_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [similarity(*_set(x["set_a"], x["often_a"]), *_set(x["set_b"], x["often_b"])) >= threshold for k in range(batch.num_rows) for x in batch.slice(k, 1).to_pylist()]
            yield batch.select(names).filter(pa.array(keep, pa.bool_()))

    names = pairs.columns
    return map_arrow(joined, run, joined.select(*names).schema)


def _dealt(rows: DataFrame, m: str, mass: str) -> DataFrame:
    """``rows`` with the block of their bucket they belong to, ``own``."""
    return rows.withColumn("own", F.pmod(F.xxhash64("uid"), _blocks(m, mass)).cast("int"))


def _blocks(m: str, mass: str) -> F.Column:
    return F.ceil(F.greatest(F.col(m) / BLOCK, F.col(mass) / BLOCK_MASS)).cast("int")


def across(rows: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(ca, cb): components that a link joins, of strays and all texts of their bucket.

    ``rows`` has h, uid, c0, c, the bucket's main component, its texts m and shingles mass, and those of its
    strays, sm and smass. Blocks of strays meet blocks of all texts. The shares x and y of two texts' weights
    that lie in the other one bound their similarity by xy / (x + y - xy); only pairs that this lets through
    are computed exactly. A task returns each pair of components once.
    """
    stray = F.col("c") != F.col("main")
    probe = _dealt(rows.filter(stray), "sm", "smass").select("h", F.col("own").alias("i"), F.explode(F.sequence(F.lit(0), _blocks("m", "mass") - 1)).alias("j"), F.lit(True).alias("probe"), "uid", "c0", "c", stray.alias("stray"))
    every = _dealt(rows, "m", "mass").select("h", F.explode(F.sequence(F.lit(0), _blocks("sm", "smass") - 1)).alias("i"), F.col("own").alias("j"), F.lit(False).alias("probe"), "uid", "c0", "c", stray.alias("stray"))
    spread = probe.unionByName(every).join(sets, "uid")

    def run(t: pa.Table) -> pa.Table:
        ids, comp, home = (np.array(t.column(c).to_pylist()) for c in ("uid", "c", "c0"))
        left, stray = np.array(t.column("probe").to_pylist()), np.array(t.column("stray").to_pylist())
        members, weight = zip(*(_set(s, c) for s, c in zip(t.column("shingles").to_pylist(), t.column("counts").to_pylist())))
        p, e = np.flatnonzero(left), np.flatnonzero(~left)
        row = np.repeat(np.arange(len(ids)), [len(s) for s in members])
        _, col, often = np.unique(np.concatenate(members), return_inverse=True, return_counts=True)
        share = np.concatenate([w / w.sum() for w in weight])
        common = often[col] > 1
        row, share, col = row[common], share[common], (np.cumsum(often > 1) - 1)[col[common]]
        order = np.argsort(col, kind="stable")
        row, share, col = row[order], share[order], col[order]
        mass, back = np.zeros((len(p), len(e)), "f4"), np.zeros((len(p), len(e)), "f4")
        for at in range(0, int(col[-1]) + 1 if len(col) else 0, COLUMNS):
            lo, hi = np.searchsorted(col, (at, at + COLUMNS))
            part = np.zeros((2, len(ids), COLUMNS), "f4")
            part[0, row[lo:hi], col[lo:hi] - at] = share[lo:hi]
            part[1, row[lo:hi], col[lo:hi] - at] = 1
            mass += part[0, p] @ part[1, e].T
            back += part[1, p] @ part[0, e].T
        # By concavity no weights with these shares are more alike than that; equal weights are just so.
        bound = mass * back / np.maximum(mass + back - mass * back, 1e-9)
        near = (bound >= threshold - 1e-4) & (comp[p][:, None] != comp[e])
        # Two strays meet in both orders.
        near &= ~stray[e] | (ids[p][:, None] < ids[e])
        found = set()
        for x, y in zip(*np.nonzero(near)):
            key = (int(home[p[x]]), int(home[e[y]]))
            if key not in found and similarity(members[p[x]], weight[p[x]], members[e[y]], weight[e[y]]) >= threshold:
                found.add(key)
        a, b = zip(*sorted(found)) if found else ((), ())
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["ca", "cb"])

    return spread.groupBy("h", "i", "j").applyInArrow(run, "ca long, cb long")


def _open(placed: DataFrame) -> DataFrame:
    """The rows of buckets with several components, with what ``across`` needs of the bucket."""
    by = placed.groupBy("h", "c").agg(F.count("*").alias("k"), F.sum("n").alias("ks"))
    top = F.max(F.struct("k", "ks", "c"))
    per = by.groupBy("h").agg(top.alias("top"), F.sum("k").alias("m"), F.sum("ks").alias("mass")).filter("top.k < m")
    per = per.select("h", F.col("top.c").alias("main"), "m", "mass", (F.col("m") - F.col("top.k")).alias("sm"), (F.col("mass") - F.col("top.ks")).alias("smass"))
    return durable(placed.join(durable(per), "h").select("h", "uid", "n", "c0", "c", "main", "m", "mass", "sm", "smass"))


def _joined(placed: DataFrame, links: DataFrame | None) -> DataFrame:
    """``placed`` with ``c`` by all links between first components so far."""
    if links is None:
        return placed.select("h", "uid", "n", "c0", "c")
    up = components(links, "ca", "cb").select(F.col("node").alias("c0"), "component")
    return placed.select("h", "uid", "n", "c0").join(up, "c0", "left").select("h", "uid", "n", "c0", F.coalesce("component", "c0").alias("c"))


def _late(shared: DataFrame, label: DataFrame, sets: DataFrame, threshold: float) -> DataFrame | None:
    """(ca, cb): links between the components of buckets that hold several."""
    placed = shared.join(label.withColumnRenamed("node", "uid"), "uid", "left").select("h", "uid", "n", F.coalesce("component", "uid").alias("c0")).withColumn("c", F.col("c0"))
    placed = _open(placed)
    few = placed.filter(F.col("m") <= FEW)
    x, y = few.select("h", F.col("uid").alias("a"), F.col("c").alias("ca")), few.select("h", F.col("uid").alias("b"), F.col("c").alias("cb"))
    first = x.join(y, "h").filter((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb"))).select("a", "b", "ca", "cb").distinct()
    links, placed = None, placed.filter(F.col("m") > FEW)

    def add(more: DataFrame) -> DataFrame | None:
        more = durable(more.select("ca", "cb").distinct())
        if more.isEmpty():
            return links
        return more if links is None else durable(links.union(more))

    links = add(verify(first, sets, threshold))
    for k in range(DRAWS):
        if placed.isEmpty():
            return links
        placed = _open(_joined(placed, links))
        drawn = placed.filter("c = main").groupBy("h").agg(F.min_by(F.struct("uid", "c0"), F.xxhash64("uid", "h", F.lit(k))).alias("d"))
        tried = placed.filter("c <> main").join(durable(drawn), "h").select(F.col("d.uid").alias("a"), F.col("uid").alias("b"), F.col("d.c0").alias("ca"), F.col("c0").alias("cb")).distinct()
        links = add(verify(tried, sets, threshold))
    placed = _open(_joined(placed, links))
    return links if placed.isEmpty() else add(across(placed, sets, threshold))


def classes(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """uid, doc_id, hash of the text, class_id, class_size and kept of every row, which ``uid`` numbers."""
    every = durable(sketch(documents).withColumn("uid", F.monotonically_increasing_id()))
    solid = every.filter("n > 0")
    copies = durable(solid.groupBy("k1", "k2").agg(F.min("uid").alias("head"), F.count("*").alias("size")).filter("size > 1").drop("size"))
    member = durable(solid.select("uid", "doc_id", "t", "k1", "k2").join(copies, ["k1", "k2"], "left").select("uid", "doc_id", "t", F.coalesce("head", "uid").alias("head")))
    reps = solid.join(member.filter("uid <> head").select("uid"), "uid", "left_anti")

    banded = durable(reps.select("uid", "n", F.explode("bands").alias("h")))
    buckets = durable(banded.groupBy("h").agg(F.min("uid").alias("hub"), F.max("uid").alias("top")).filter("hub < top").drop("top"))
    shared = durable(banded.join(buckets, "h").select("h", "hub", "uid", "n"))
    pairs = durable(shared.filter("uid <> hub").select(F.col("hub").alias("a"), F.col("uid").alias("b")).distinct())

    ids = pairs.select(F.col("a").alias("uid")).union(pairs.select("b")).distinct()
    sets = durable(every.select("uid", "shingles", "counts").join(ids, "uid", "left_semi"))
    label = components(durable(verify(pairs, sets, threshold)))
    late = _late(shared.select("h", "uid", "n"), label, sets, threshold)
    home = member.join(label.withColumnRenamed("node", "head"), "head", "left").select("uid", "doc_id", "t", "head", F.coalesce("component", "head").alias("c"))
    if late is not None:
        home = home.join(components(late, "ca", "cb").withColumnRenamed("node", "c"), "c", "left").select("uid", "doc_id", "t", "head", F.coalesce("component", "c").alias("c"))
    # A row is alone unless another one has its component, which is the smallest row number of its class.
    home = durable(home)
    crowd = home.groupBy("c").agg(F.count("*").alias("class_size"), F.min("doc_id").alias("class_id"), F.min("uid").alias("low"), F.max("uid").alias("high"))
    crowd = durable(crowd.filter("low < high").drop("low", "high"))
    inside = home.join(crowd, "c", "left")
    kept = durable(home.join(crowd, "c").filter(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("c").agg(F.min("uid").alias("keeper")))
    named = inside.join(kept, "c", "left").select("uid", "doc_id", "t", F.when(F.col("class_size").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"), (F.col("uid") == F.coalesce("keeper", "uid")).alias("kept"))
    alone = every.filter("n = 0").select("uid", "doc_id", "t", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept"))
    return named.unionByName(alone)


def near_duplicates(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id, kept (whether the row stands for its class) and class_size, the rows of the class."""
    return classes(documents, threshold).select("doc_id", "class_id", "kept", "class_size")


def deduplicate(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each class, in its own columns."""
    found = durable(classes(documents, threshold).select("doc_id", "t", "kept", "class_size"))
    # Rows are known again by doc_id and the hash of the text; where both recur, one row stays.
    each = found.filter("class_size > 1").groupBy("doc_id", "t").agg(F.max("kept").alias("kept"), F.count("*").alias("times"))
    each = durable(each.select(F.col("doc_id").alias("__doc_id"), F.col("t").alias("__t"), "kept", "times"))
    same = lambda df, found: df["doc_id"].eqNullSafe(found["__doc_id"]) & (df["__text"] == found["__t"])
    gone, twice = each.filter("NOT kept").drop("kept", "times"), each.filter("kept AND times > 1").drop("kept", "times")
    rows = documents.withColumn("__text", F.xxhash64("text"))
    left = rows.join(gone, same(rows, gone), "left_anti")
    if not twice.isEmpty():
        again = left.join(twice, same(left, twice), "left_semi").dropDuplicates(["doc_id", "__text"])
        left = left.join(twice, same(left, twice), "left_anti").unionByName(again)
    return left.select(*documents.columns)
