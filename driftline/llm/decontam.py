"""Benchmark decontamination with a generalised suffix automaton over item words.

The items' words (ASCII lower-cased, runs of ASCII letters, digits and non-ASCII characters) are fed
into one suffix automaton whose alphabet is word ids. A document streams its words through it; the
automaton tracks, for each word, the longest suffix that occurs in any item. A suffix of at least
``window`` words means that a window of an item ends here. Items of fewer words are one window each.

Scale: the automaton is broadcast, and its size is checked: items are put into blocks of at most
``BLOCK_WORDS`` words, and each block is one more Arrow pass chained in the same stage, without any
shuffle of documents. After every ``CHAINED`` blocks the documents and what was found are written to the
checkpoint folder, so that a task never holds more automata than that, however large the benchmark; items stream
through the driver, one block at a time. Everything else is per document.

Defined results: a null or empty text has no words, no hits and is clean; a null item text has no
windows; repeated items count once by ``item_id``; a null ``item_id`` marks words but is not listed;
an empty benchmark marks nothing; extra columns are ignored by ``scan`` and kept by ``decontaminate``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from driftline.functions.durable import durable
from driftline.llm.arrowio import chunks, map_arrow, raw

WINDOW = 10
#: Words of items in one automaton; it has at most twice as many states.
BLOCK_WORDS = 100_000
#: Blocks scanned in one stage.
CHAINED = 4

_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    """Normalised words of a UTF-8 text."""
    return text.translate(_WORD_BYTES).split()


class Automaton:
    """Generalised suffix automaton of word sequences, with the items that hold each state."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int) -> None:
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        owners: list[set[int]] = [set()]
        short: dict[int, set[int]] = {}
        self.names = [name for name, _ in items]
        for number, (_, item) in enumerate(items):
            ids = [self.vocab.setdefault(w, len(self.vocab)) for w in item]
            last = 0
            for w in ids:
                last = self._extend(last, w, owners)
                owners[last].add(number)
            if 0 < len(ids) < window:
                short.setdefault(last, set()).add(number)
        order = sorted(range(1, len(self.link)), key=self.length.__getitem__)
        for v in reversed(order):
            owners[self.link[v]] |= owners[v]
        # For a match of at least `window` words in v: the items holding the last `window` of them.
        # For shorter ones: short items that are whole suffixes, v's own if the whole of v matched.
        self.window_items: list[frozenset[int] | None] = [None] * len(self.link)
        self.own_short: list[tuple[int, frozenset[int]] | None] = [None] * len(self.link)
        self.up_short: list[tuple[int, frozenset[int]] | None] = [None] * len(self.link)
        anchor: dict[int, int] = {}
        for v in order:
            up = self.link[v]
            if self.length[v] >= window:
                anchor[v] = v if self.length[up] < window else anchor[up]
                self.window_items[v] = frozenset(owners[anchor[v]])
            above = self.own_short[up] or self.up_short[up] if up > 0 else None
            self.up_short[v] = above
            if v in short:
                self.own_short[v] = (max(self.length[v], above[0] if above else 0), frozenset(short[v]) | (above[1] if above else frozenset()))
        self.least = min([window] + [len(i) for _, i in items if i])

    def _extend(self, last: int, w: int, owners: list[set[int]]) -> int:
        nxt, link, length = self.next, self.link, self.length
        known = nxt[last].get(w)
        if known is not None and length[known] == length[last] + 1:
            return known
        if known is not None:
            return self._clone(last, w, known, owners)
        cur = self._state(length[last] + 1, {}, 0, owners)
        p = last
        while p != -1 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q, owners)
        return cur

    def _state(self, length: int, edges: dict[int, int], link: int, owners: list[set[int]]) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        owners.append(set())
        return len(self.link) - 1

    def _clone(self, p: int, w: int, q: int, owners: list[set[int]]) -> int:
        c = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q], owners)
        self.link[q] = c
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def match(self, tokens: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Merged hit ranges of word positions, end exclusive, and the numbers of the items."""
        nxt, link, length, least, window = self.next, self.link, self.length, self.least, self.window
        spans: list[list[int]] = []
        found: set[int] = set()
        v = n = 0
        for i, w in enumerate(map(self.vocab.get, tokens)):
            if w is None:
                v = n = 0
                continue
            to = nxt[v].get(w)
            while to is None and v:
                v = link[v]
                n = length[v]
                to = nxt[v].get(w)
            if to is None:
                v = n = 0
                continue
            v = to
            n += 1
            if n < least:
                continue
            reach = 0
            if n >= window:
                # v may hold longer strings than matched, but any of them ends in the same window.
                reach = window
                found |= self.window_items[v]
            brief = self.own_short[v] if n == length[v] and self.own_short[v] else self.up_short[v]
            if brief:
                reach = max(reach, brief[0])
                found |= brief[1]
            if reach:
                start = i + 1 - reach
                while spans and spans[-1][0] >= start:
                    spans.pop()
                if spans and spans[-1][1] >= start:
                    spans[-1][1] = i + 1
                else:
                    spans.append([start, i + 1])
        return [(a, b) for a, b in spans], found


def _blocks(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    rows = benchmark.select(F.col("item_id").cast("string").alias("i"), raw().alias("t")).distinct().orderBy("i", "t")
    held: list[tuple[str | None, list[bytes]]] = []
    size = 0
    for row in rows.toLocalIterator():
        item = words(bytes(row["t"]))
        if not item:
            continue
        if held and size + len(item) > limit:
            yield held
            held, size = [], 0
        held.append((row["i"], item))
        size += len(item)
    if held:
        yield held


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and out[-1][1] >= a:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _pass(shared, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One block's scan; adds to the ranges and items that earlier blocks have found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = shared.value
        for batch in chunks(batches, "__raw"):
            counts, spans, items = [], [], []
            for text, old, names in zip(*(batch.column(c).to_pylist() for c in ("__raw", "hit_ranges", "hit_items"))):
                tokens = words(text)
                counts.append(len(tokens))
                if auto is not None:
                    got, found = auto.match(tokens)
                    if got:
                        old = np.array(_merge([*zip(old[::2], old[1::2]), *got]), "i8").ravel().tolist()
                    if found:
                        names = sorted({*names, *(auto.names[k] for k in found if auto.names[k] is not None)})
                spans.append(old)
                items.append(names)
            new = {"n_words": pa.array(counts, pa.int64()), "hit_ranges": pa.array(spans, pa.list_(pa.int64())), "hit_items": pa.array(items, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([new[f.name] if f.name in new else batch.column(f.name).cast(f.type) for f in schema], schema=schema)

    return run


def scan(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, keep: tuple[str, ...] = ("doc_id",), block_words: int = BLOCK_WORDS) -> DataFrame:
    """``keep``, n_words, hit_ranges (flat start, end word positions) and hit_items of every document."""
    return _scan(documents, benchmark, window, keep, block_words).drop("__raw")


def _scan(documents: DataFrame, benchmark: DataFrame, window: int, keep: tuple[str, ...], block_words: int = BLOCK_WORDS, then: Callable | None = None, schema: StructType | None = None) -> DataFrame:
    """``then`` takes the last pass's batches, with __raw, in the same worker and returns ``schema``."""
    df = documents.select(*keep, raw().alias("__raw"), F.lit(0).cast("bigint").alias("n_words"), F.array().cast("array<bigint>").alias("hit_ranges"), F.array().cast("array<string>").alias("hit_items"))
    sc = documents.sparkSession.sparkContext
    held, blocks = [], _blocks(benchmark, block_words)
    block = next(blocks, None)
    while True:
        following = next(blocks, None) if block else None
        held.append(sc.broadcast(Automaton(block, window) if block else None))
        one = _pass(held[-1], to_arrow_schema(df.schema))
        if following is None:
            return map_arrow(df, one, df.schema) if then is None else map_arrow(df, lambda batches: then(one(batches)), schema)
        df, block = map_arrow(df, one, df.schema), following
        if len(held) == CHAINED:
            df = durable(df)
            for x in held:
                x.unpersist()
            held = []


def digest(found: DataFrame) -> DataFrame:
    """The per-document summary of ``scan``."""
    ranges = F.transform(F.sequence(F.lit(0), F.size("hit_ranges") - 1), lambda k: F.when(k % 2 == 1, F.get("hit_ranges", k)).otherwise(-F.get("hit_ranges", k)))
    hit = F.when(F.size("hit_ranges") > 0, F.aggregate(ranges, F.lit(0).cast("bigint"), lambda a, x: a + x)).otherwise(F.lit(0).cast("bigint"))
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("hit_items").cast("bigint").alias("n_items"), F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), (F.size("hit_ranges") > 0).alias("contaminated"))


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_words: int = WINDOW, max_coverage: float = 0.5) -> DataFrame:
    """Documents without leaked passages, in their own columns.

    Hit ranges of at least ``max_words`` words, or of whole short items, are cut out of the text. A
    document of which more than ``max_coverage`` of the words are hit is dropped whole. Texts without a
    hit pass unchanged, byte for byte. A range of fewer than ``window`` words comes from short items only.
    """
    columns = documents.columns
    # The text travels once, as __raw; its place in the row only says whether it is null.
    rest = F.struct(F.col("text").isNull().alias("__none"), *(F.col(c) for c in columns if c != "text")).alias("__row")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keep = [], []
            for text, n, spans in zip(*(batch.column(c).to_pylist() for c in ("__raw", "n_words", "hit_ranges"))):
                pairs = list(zip(spans[::2], spans[1::2]))
                if not pairs or sum(b - a for a, b in pairs) <= max_coverage * n:
                    pairs = [(a, b) for a, b in pairs if b - a >= max_words or b - a < window]
                    texts.append(_without(text, pairs) if pairs else text)
                    keep.append(True)
                else:
                    texts.append(b"")
                    keep.append(False)
            yield pa.RecordBatch.from_arrays([batch.column("__row"), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(keep)], ["__row", "text", "keep"])

    out = _scan(documents.select("text", rest), benchmark, window, ("__row",), then=cut, schema=documents.select(rest).schema.add("text", "string").add("keep", "boolean"))
    text = F.when(~F.col("__row")["__none"], F.col("text")).alias("text")
    return out.filter("keep").select(*(text if c == "text" else F.col("__row")[c].alias(c) for c in columns))


def _without(data: bytes, pairs: list[tuple[int, int]]) -> bytes:
    """The text without the words of the ranges; what stands between two removed words goes too."""
    flat = np.frombuffer(data.translate(_WORD_BYTES), "u1") != 32
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flat.view("i1"), [0]))))
    starts, ends = edge[::2], edge[1::2]
    out, at = [], 0
    for a, b in pairs:
        out.append(data[at : starts[a]])
        at = ends[b - 1]
    return b"".join([*out, data[at:]])


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    return digest(scan(documents, benchmark, window))
