"""Quality classifier by co-training of a text view and a page-metadata view.

The text view sees the normalised words and what stands between letters (runs of signs), present or not.
The metadata view sees what is known of the page without reading it: source, language, and measures of
its layout (length, lines, repeated lines, shares of capitals, digits, signs), in steps. Both are
logistic models fitted by FTRL. In each round each view labels every page outside the labelled sample of
which it is sure, and all of those join the other view's training rows. In the end both are calibrated and
combined by a logistic model of their two scores on labelled rows held back.

Scale: the labelled rows, about ``SAMPLE`` at most, drawn by a hash of the id, are fitted on the driver. A
round is one Arrow pass over all other documents: each task goes on from that fit with its own sure pages,
and a feature's weight is the mean over tasks and the labelled fit, weighed by the rows that hold it. Only
these sums are shuffled. The model grows with the features that have a weight; so do its broadcast and the
driver. The result depends a little on how rows are dealt over tasks. Scoring is one more pass.

Defined results: null and empty texts are scored by their metadata and the bias; null metadata is a value
of its own; without labels every score is 1 and all is kept; with labels of one class alone every score is
the smoothed share of good ones among them; extra columns are ignored and, in ``keep``, returned as they
were; a source or language is one feature, whatever characters it holds.
"""

from __future__ import annotations

import math
from collections.abc import Collection, Iterator
from functools import cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.arrowio import chunks, map_arrow, raw, release
from driftline.llm.decontam import _WORD_BYTES
from driftline.llm.linear import in_sample, labelled, logistic, sigmoid
from driftline.llm.toxicity import vocabulary

SAMPLE = 5000
ROUNDS, EPOCHS = 3, 3
#: A view hands over the rows of which it is at least this sure.
SURE = 0.95
#: Features of the labelled rows; the other rows add theirs without a bound.
VOCABULARY = 1 << 15
#: New features a learning task holds of a view before it emits them and starts a further part.
HELD = 1_000_000
LIMIT = 0.5

_LETTERS = bytes([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)])
_NOT_SIGN = _LETTERS + b" \t\n\v\f\r"
_NOT_UPPER = bytes(b for b in range(256) if not 65 <= b <= 90)
_NOT_DIGIT = bytes(b for b in range(256) if not 48 <= b <= 57)


@cache
def _measure(name: str, k: int) -> bytes:
    return f"m:{name}:{k}".encode()


def _step(name: str, x: float) -> bytes:
    return _measure(name, int(math.log2(x + 1) * 2))


def _share(name: str, part: int, whole: int) -> bytes:
    return _measure(name, math.ceil(20 * part / whole) if whole else -1)


def _split(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words between blanks, all words by their place in these (-1: none), and how many each text has."""
    # Only ASCII matters to the split, so that the bytes need not be checked. Blanks at either end leave empty words.
    parts = pc.ascii_split_whitespace(pa.array(texts, pa.binary()).view(pa.string()))
    found = parts.flatten().dictionary_encode()
    names, places = found.dictionary.view(pa.binary()), np.asarray(found.indices)
    empty = pc.index(names, pa.scalar(b"", pa.binary())).as_py()
    return names, np.where(places == empty, -1, places) if empty >= 0 else places, np.asarray(pc.list_value_length(parts))


def contents(texts: list[bytes]) -> tuple[list[bytes], list[np.ndarray]]:
    """Features of the text view: those of all texts, and each text's by their place in these, once each."""
    words, of_words, n_words = _split([text.translate(_WORD_BYTES) for text in texts])
    signs, of_signs, n_signs = _split([text.translate(None, _LETTERS) for text in texts])
    text = np.arange(len(texts)) << 32
    key = np.concatenate((np.repeat(text, n_words) | of_words, np.repeat(text, n_signs) | np.where(of_signs < 0, -1, of_signs + len(words))))
    key.sort()
    key = key[np.flatnonzero(np.diff(key, prepend=-1))]
    words, signs = (x.to_numpy(zero_copy_only=False).tolist() for x in (words, signs))
    return words + [b"s:" + x for x in signs], np.split(key & 0xFFFFFFFF, np.searchsorted(key, text[1:]))


def traits(text: bytes, source: str | None, lang: str | None, n_chars: int | None) -> set[bytes]:
    """Features of the metadata view."""
    lines = text.split(b"\n")
    return {
        f"m:source:{source}".encode(),
        f"m:lang:{lang}".encode(),
        _step("chars", n_chars) if n_chars is not None and n_chars >= 0 else b"m:chars:?",
        _step("line", len(text) / len(lines)),
        _share("repeated", len(lines) - len(set(lines)), len(lines)),
        _share("upper", len(text.translate(None, _NOT_UPPER)), len(text)),
        _share("digit", len(text.translate(None, _NOT_DIGIT)), len(text)),
        _share("sign", len(text.translate(None, _NOT_SIGN)), len(text)),
    }


def views(batch: pa.RecordBatch, columns: Collection[str]) -> tuple[list[bytes], list[np.ndarray], list[set[bytes]]]:
    """Features of the text view, each text's by their place in these, and each text's of the metadata view.

    ``columns`` are the text and the page's source, language and length.
    """
    text, *known = (batch.column(c) for c in columns)
    texts = text.to_pylist()
    return *contents(texts), [traits(*row) for row in zip(texts, *(c.to_pylist() for c in known))]


_INPUT = ("source", "lang", "n_chars")


def _typed(documents: DataFrame) -> list:
    return [F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("n_chars").cast("long").alias("n_chars")]


def _collect(sample: DataFrame) -> list[dict]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "__raw"):
            names, content, meta = views(batch, ("__raw", *_INPUT))
            bags = [[names[k] for k in places.tolist()] for places in content], meta
            packed = [pa.array([sorted(x) for x in view], pa.list_(pa.binary())) for view in bags]
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("t"), batch.column("quality"), *packed], ["h", "t", "quality", "content", "meta"])

    df = sample.select(F.xxhash64(F.col("doc_id").cast("string"), F.lit("fold")).alias("h"), F.xxhash64("text").alias("t"), F.col("quality").cast("int").alias("quality"), raw().alias("__raw"), *_typed(sample))
    # Each feature is one object, however many rows hold it.
    same: dict[bytes, bytes] = {}
    one = lambda bag: {same.setdefault(w, w) for w in bag}
    rows = []
    for batch in map_arrow(df, run, "h long, t long, quality int, content array<binary>, meta array<binary>").toArrow().to_batches(max_chunksize=64):
        rows += [{"h": r["h"], "t": r["t"], "quality": r["quality"], "content": one(r["content"]), "meta": one(r["meta"])} for r in batch.to_pylist()]
    return sorted(rows, key=lambda r: (r["h"], r["t"], r["quality"], sorted(r["meta"])))


class Learner:
    """Logistic FTRL with elastic net on sets of features; its table grows with the features it meets."""

    ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.5, 0.1

    def __init__(self, start: tuple[list[bytes], np.ndarray, np.ndarray] = ([b""], np.zeros(1), np.zeros(1))) -> None:
        names, z, root = start
        self.index = {w: k for k, w in enumerate(names)}
        # A row a feature, so that its z, root and rows seen are read and written at once.
        self.table = np.stack((z, root, np.zeros(len(z))), 1)
        self.rows = 0

    def _weights(self, z: np.ndarray, root: np.ndarray, free: int) -> np.ndarray:
        """Weights at these states; the one at place ``free``, the bias, has no penalty."""
        w = np.copysign(np.maximum(np.abs(z) - self.L1, 0), z)
        w /= (root + self.BETA) / -self.ALPHA - self.L2
        w[free] = -z[free] * self.ALPHA / (self.BETA + root[free])
        return w

    def places(self, bag: Collection[bytes]) -> np.ndarray:
        """Where the bias and the features are in the table; -1 for those not met yet."""
        return np.fromiter(chain((0,), map(self.index.get, bag, repeat(-1))), "i8", len(bag) + 1)

    def add(self, names: list[bytes]) -> np.ndarray:
        """Places for features not met yet."""
        places = np.arange(len(self.index), len(self.index) + len(names))
        self.index.update(zip(names, places.tolist()))
        if len(self.index) > len(self.table):
            self.table = np.concatenate((self.table, np.zeros((len(self.index) + 1024, 3))))
        return places

    def learn(self, bag: Collection[bytes], label: int, at: np.ndarray | None = None) -> None:
        at = self.places(bag) if at is None else at
        new = np.flatnonzero(at < 0)
        if len(new):
            names = list(bag)
            at[new] = self.add([names[k - 1] for k in new.tolist()])
        self.update(at, label)

    def update(self, at: np.ndarray, label: int) -> None:
        """Learn from a row that has the features at these places, the bias first."""
        rows = self.table.take(at, 0)
        z, root, seen = rows.T
        w = self._weights(z, root, 0)
        g = 1 / (1 + math.exp(-min(max(float(w.sum()), -40.0), 40.0))) - label
        after = np.sqrt(root * root + g * g)
        w *= (after - root) / self.ALPHA
        z -= w
        z += g
        root[:] = after
        seen += 1
        self.table[at] = rows
        self.rows += 1

    def forget_rows(self) -> None:
        """Count the rows of each feature anew."""
        self.table[:, 2] = 0

    def state(self) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        z, root, _ = self.table[: len(self.index)].T.copy()
        return list(self.index), z, root

    def part(self, view: int) -> pa.RecordBatch:
        """Each feature met, the rows it was met in and its weight times these."""
        names = list(self.index)
        met = np.flatnonzero(self.table[: len(names), 2])
        z, root, seen = self.table[met].T
        w = self._weights(z, root, 0)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(met), view, "i4")), pa.array([names[k] for k in met.tolist()], pa.binary()), pa.array(seen.astype("i8")), pa.array(seen * w)], ["view", "feature", "c", "cw"])


def _sum(weights: dict, bag: Collection[bytes]) -> float:
    return math.fsum(map(weights.get, bag, repeat(0.0)))


def _union(start: tuple, weights: dict) -> tuple[tuple, np.ndarray]:
    """The state of the fit to the labelled rows with room for every feature that has a weight, and the weights.

    The bias, which is at place 0, and the place after the last have no weight here.
    """
    names, z, root = start
    known = set(names)
    more = [w for w in weights if w not in known]
    place = np.array([*map(weights.get, [*names, *more], repeat(0.0)), 0.0])
    return ([*names, *more], np.append(z, np.zeros(len(more))), np.append(root, np.zeros(len(more)))), place


def hand_over(documents: DataFrame, starts: list[tuple], weights: list[dict], bias: list[float]) -> DataFrame:
    """Parts (view, feature, c, cw) of both views, fitted to all documents of which the other view is sure.

    Every part goes on from ``starts``, the fit to the labelled rows.
    """
    shared = documents.sparkSession.sparkContext.broadcast(([_union(s, w) for s, w in zip(starts, weights)], bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, bias = shared.value
        learners, known = [Learner(s) for s, _ in both], [len(s[0]) for s, _ in both]
        sure = math.log(SURE / (1 - SURE))
        for batch in chunks(batches, "__raw"):
            names, content, meta = views(batch, ("__raw", *_INPUT))
            # Each feature of the batch is looked up once, whatever texts hold it.
            place = learners[0].places(names)[1:]
            for words, bag in zip(content, meta):
                places = [np.append(0, place[words]), learners[1].places(bag)]
                # Features beyond the first ones were met in this task, or not yet, and read a weight of 0.
                s = [bias[v] + float(both[v][1].take(places[v], mode="clip").sum()) for v in (0, 1)]
                if abs(s[0]) >= sure:
                    learners[1].learn(bag, int(s[0] > 0), places[1])
                if abs(s[1]) >= sure:
                    new = np.flatnonzero(places[0] < 0)
                    if len(new):
                        own = words[new - 1]
                        place[own] = places[0][new] = learners[0].add([names[k] for k in own.tolist()])
                    learners[0].update(places[0], int(s[1] > 0))
            for v in (0, 1):
                if len(learners[v].index) > known[v] + HELD:
                    yield learners[v].part(v)
                    learners[v] = Learner(both[v][0])
        for v in (0, 1):
            if learners[v].rows:
                yield learners[v].part(v)

    return map_arrow(documents.select(raw().alias("__raw"), *_typed(documents)), run, "view int, feature binary, c long, cw double")


def fit(rows: list[dict], fresh: DataFrame, rounds: int = ROUNDS):
    """Weights of both views and the combining model; without labels None, with one class its smoothed share."""
    if not rows:
        return None
    if len({r["quality"] for r in rows}) < 2:
        return (sum(r["quality"] for r in rows) + 1) / (len(rows) + 2)
    bags = [[r[view] for view in ("content", "meta")] for r in rows]
    y = np.array([r["quality"] for r in rows])
    back = np.array([r["h"] % 4 == 0 for r in rows])
    if len(set(y[back])) < 2 or len(set(y[~back])) < 2:
        back[:] = False
    own_rows = np.flatnonzero(~back)
    starts, parts = [], []
    for v in (0, 1):
        vocab = vocabulary([bags[i][v] for i in own_rows], VOCABULARY)
        learner, rng = Learner(), np.random.default_rng(3)
        kept = {int(i): sorted(bags[i][v] & vocab.keys()) for i in own_rows}
        for epoch in range(EPOCHS):
            if epoch:
                learner.forget_rows()
            for i in rng.permutation(own_rows).tolist():
                learner.learn(kept[i], int(y[i]))
        starts.append(learner.state())
        parts.append(learner.part(v))
    labelled_part = pa.Table.from_batches(parts)

    def model(part: pa.Table) -> tuple[list[dict], list[float]]:
        weights: list[dict] = [{}, {}]
        for batch in part.to_batches(max_chunksize=1 << 14):
            for v, w, c, cw in zip(*(batch.column(c).to_pylist() for c in ("view", "feature", "c", "cw"))):
                if cw:
                    weights[v][w] = cw / c
        return weights, [w.pop(b"", 0.0) for w in weights]

    weights, bias = model(labelled_part)
    for _ in range(rounds):
        found = hand_over(fresh, starts, weights, bias).unionByName(fresh.sparkSession.createDataFrame(labelled_part))
        mixed = found.groupBy("view", "feature").agg(F.sum("c").alias("c"), F.sum("cw").alias("cw"))
        weights, bias = model(mixed.filter(F.col("cw") != 0).toArrow())
        del found, mixed
        release()
    at = np.flatnonzero(back) if back.any() else np.arange(len(y))
    scores = np.array([[bias[v] + _sum(weights[v], bags[i][v]) for v in (0, 1)] for i in at])
    own = [logistic(np.clip(scores[:, [v]], -20, 20), y[at]) for v in (0, 1)]
    both = logistic(np.clip(scores, -20, 20), y[at])
    return weights, bias, own, both


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, rounds: int = ROUNDS):
    columns = ["doc_id", "text", *_INPUT]
    judged = labels.filter(F.col("quality").isNotNull())
    rows = _collect(labelled(documents, judged, sample, columns))
    # The sample's own documents alone are no fresh ones; its ids are as few as it is.
    total = judged.select(F.count("doc_id")).first()[0]
    ids = judged.filter(in_sample(sample / max(total, sample))).select("doc_id").distinct()
    model = fit(rows, documents.select(*columns).join(F.broadcast(ids), "doc_id", "left_anti"), rounds)
    del rows
    release()
    return model


def score(documents: DataFrame, model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, p_text, p_meta (each view calibrated) and score, the probability of good quality."""
    df = documents.select(*keep, raw().alias("__raw"), *(c.alias("__" + n) for n, c in zip(_INPUT, _typed(documents))))
    schema = df.select(*keep).schema.add("p_text", "double").add("p_meta", "double").add("score", "double")
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        if isinstance(model, tuple):
            weights, bias, own, both = model
        for batch in chunks(batches, "__raw"):
            p = np.full((batch.num_rows, 3), 1.0 if model is None else model if isinstance(model, float) else 0.0)
            if isinstance(model, tuple):
                names, content, meta = views(batch, ("__raw", *("__" + n for n in _INPUT)))
                found = np.fromiter(map(weights[0].get, names, repeat(0.0)), "f8", len(names))
                s = np.array([(bias[0] + found[words].sum(), bias[1] + _sum(weights[1], bag)) for words, bag in zip(content, meta)])
                s = np.clip(s, -20, 20)
                p = np.stack([sigmoid(own[0][0] + own[0][1] * s[:, 0]), sigmoid(own[1][0] + own[1][1] * s[:, 1]), sigmoid(both[0] + s @ both[1:])], 1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(p[:, k]) for k in range(3))], schema.names)

    return map_arrow(df, run, schema)


def classify(documents: DataFrame, labels: DataFrame, limit: float = LIMIT) -> DataFrame:
    """doc_id, p_text, p_meta, score and keep of every document."""
    return score(documents, train(documents, labels)).withColumn("keep", F.col("score") >= limit)


def keep(documents: DataFrame, labels: DataFrame, limit: float = LIMIT) -> DataFrame:
    """The documents of good quality, in their own columns."""
    columns = documents.columns
    whole = documents.select(F.struct(*columns).alias("__row"), "text", *_INPUT)
    scored = score(whole, train(documents, labels), ("__row",))
    return scored.filter(F.col("score") >= limit).select(*(F.col("__row")[c].alias(c) for c in columns))
