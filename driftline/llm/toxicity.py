"""Toxicity: a chain of linear classifiers, each fed with the probabilities of those before it.

A text's features are its normalised words, present or not. The categories are predicted in order. For
training, the probability of an earlier category comes from models that have not seen the row (folds);
for scoring, from the model of all rows. Each model is logistic, fitted by FTRL with an elastic net, so
that few words keep a weight. The default chain is ``severe`` (toxic and of low quality), then ``toxic``.

Scale: fitted on the driver from a sample of about ``SAMPLE`` labelled rows at most, drawn by a hash of
the id; scoring is one Arrow pass without a shuffle, with a broadcast of at most ``VOCABULARY`` words.

Defined results: null and empty texts have the bias alone; without labels every probability is the prior
0 and nothing is toxic; several labels of an id count as toxic if one is; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.arrowio import chunks, map_arrow, raw
from driftline.llm.decontam import words
from driftline.llm.linear import Sparse, ftrl, labelled, sigmoid

SAMPLE = 6000
VOCABULARY = 1 << 15
FOLDS = 4
CHAIN = ("severe", "toxic")
LIMIT = 0.5
#: Strong enough to leave words without weight that met a few toxic rows by chance.
L1 = 3.0


def collect_words(sample: DataFrame, keep: list[str]) -> list[dict]:
    """Rows of the bounded sample with their distinct words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "__raw"):
            w = [b" ".join(sorted(set(words(t)))) for t in batch.column("__raw").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(w, pa.binary())], [*keep, "words"])

    df = sample.select(*keep, raw().alias("__raw"))
    return map_arrow(df, run, df.select(*keep).schema.add("words", "binary")).toArrow().sort_by([(k, "ascending") for k in keep]).to_pylist()


def vocabulary(bags: list[set[bytes]], size: int, least: int = 3) -> dict[bytes, int]:
    seen = Counter(w for bag in bags for w in bag)
    top = sorted((w for w, n in seen.items() if n >= least), key=lambda w: (-seen[w], w))[:size]
    return {w: k for k, w in enumerate(top)}


def fit(rows: list[dict], chain: tuple[str, ...] = CHAIN, folds: int = FOLDS):
    """Weights of words, of earlier probabilities and of the bias, for each category."""
    if not rows:
        return None
    bags = [set(r["words"].split()) for r in rows]
    vocab = vocabulary(bags, VOCABULARY)
    v, models = len(vocab), []
    base = [np.array([vocab[w] for w in bag if w in vocab], "i8") for bag in bags]
    fold = np.arange(len(rows)) % folds
    prior = np.zeros((len(rows), 0))
    for k, name in enumerate(chain):
        y = np.array([[float(r[name] or 0)] for r in rows])
        feats = [(np.concatenate((b, v + np.arange(k + 1))), np.concatenate((np.ones(len(b)), p, [1.0]))) for b, p in zip(base, prior)]
        # The last feature of this link is its bias.
        learn = lambda at: ftrl(Sparse.of([feats[i] for i in at]), y[at], v + k + 1, alpha=0.5, l1=L1, l2=0.1, epochs=4, free=v + k)  # noqa: B023, E731
        models.append(learn(np.arange(len(rows)))[:, 0])
        out = np.zeros(len(rows))
        for f in range(folds):
            rest, own = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            if len(own):
                out[own] = sigmoid(Sparse.of([feats[i] for i in own]).dot(learn(rest) if len(rest) else models[-1][:, None])[:, 0])
        prior = np.hstack((prior, out[:, None]))
    used = {w: [m[j] for m in models] for w, j in vocab.items() if any(m[j] for m in models)}
    return used, [m[v:].tolist() for m in models]


def score(documents: DataFrame, model, chain: tuple[str, ...] = CHAIN, limit: float = LIMIT) -> DataFrame:
    """doc_id, the probability of each category and ``toxic``, whether the last one reaches ``limit``."""
    df = documents.select("doc_id", raw().alias("__raw"))
    schema = df.select("doc_id").schema
    for name in chain:
        schema = schema.add(f"p_{name}", "double")
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used, tails = shared.value or ({}, [])
        keys = set(used)
        for batch in chunks(batches, "__raw"):
            texts = batch.column("__raw").to_pylist()
            p = np.zeros((len(texts), len(chain)))
            for i, text in enumerate(texts):
                hit = sorted(keys.intersection(words(text)))
                sums = np.sum([used[w] for w in hit], 0) if hit else np.zeros(len(chain))
                for k, tail in enumerate(tails):
                    p[i, k] = sigmoid(sums[k] + p[i, :k] @ np.array(tail[:k]) + tail[k])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(p[:, k]) for k in range(len(chain)))], schema.names)

    return map_arrow(df, run, schema).withColumn("toxic", F.col(f"p_{chain[-1]}") >= limit)


def classify(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    rows = labelled(documents, labels, sample, ["doc_id", "text"]).withColumn("severe", F.when((F.col("toxic") == 1) & (F.col("quality") == 0), 1).otherwise(0))
    return score(documents, fit(collect_words(rows.filter(F.col("toxic").isNotNull()), ["doc_id", "severe", "toxic"])))
