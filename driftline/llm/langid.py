"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased, everything but letters becomes a blank. N-grams of 1 to 3 characters are hashed
to ``DIM`` features; a feature weighs (1 + ln tf) * idf, and a text's vector has length 1. Document
frequencies are counted over all training texts; the model is fitted by FTRL with an elastic net on a
sample of at most about ``PER_LANGUAGE`` texts of each language, a fifth of which is held back to
calibrate one temperature.

Scale: two Arrow passes over the texts and no shuffle but of DIM counts a task; the broadcast model has
DIM x languages numbers.

Defined results: null texts and texts without a letter get ``und`` and score 0; without any training
text so does everything; unlabelled training rows are not used; repeated rows give repeated results;
extra columns are ignored. Ties go to the first language by name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.arrowio import chunks, map_arrow, raw, remainder
from driftline.llm.linear import Sparse, ftrl, in_sample, softmax, temperature

BITS = 14
DIM = 1 << BITS
PER_LANGUAGE = 1000
#: Texts and characters counted in one block; a longer text stands alone and is counted in steps of so many.
ROWS, CHARS = 32, 1 << 18
UNKNOWN = "und"

_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000))
    return _LETTER[0]


def _hashes(x: np.ndarray) -> Iterator[np.ndarray]:
    """The feature of the n-gram that starts at each character, for n of 1 to 3."""
    h = np.zeros(len(x), "u4")
    for n in range(1, 4):
        h = (h[: len(x) - n + 1] if n == 1 else h[:-1]) * np.uint32(0x01000193) + x[n - 1 :]
        mixed = (h ^ (h >> np.uint32(15))) * np.uint32(2654435761) + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)
        yield (mixed ^ (mixed >> np.uint32(13))) * np.uint32(0x85EBCA6B) >> np.uint32(32 - BITS)


def long_counts(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``counts`` of one text in steps: what is left of it takes 4 bytes a character, all else a step's share."""
    letter, kept, before = _letters(), [np.array([32], "u4")], False
    for k in range(0, len(text), CHARS):
        x = np.frombuffer(text[k : k + CHARS].lower().encode("utf-32-le", "replace"), "u4")
        solid = letter[x]
        last = np.concatenate(([before], solid[:-1]))
        # The first blank after a letter stays; the text's edge counts as one.
        kept.append(np.where(solid, x, np.uint32(32))[solid | last])
        before = bool(solid[-1])
    x, total = np.concatenate([*kept, np.array([32], "u4")]), np.zeros(DIM, "i8")
    # No n-gram starts at the last edge.
    for k in range(0, len(x) - 1, CHARS):
        for h in _hashes(x[k : k + CHARS + 2]):
            total += np.bincount(h[: min(CHARS, len(x) - 1 - k)], minlength=DIM)
    at = np.flatnonzero(total)
    return np.zeros(len(at), "i8"), at, total[at], np.array([bool((x != 32).any())])


def counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature and count of each n-gram feature, and which texts have a letter."""
    if len(texts) == 1 and len(texts[0]) > CHARS:
        return long_counts(texts[0])
    joined = "\0".join(texts).lower() if "\0" not in "".join(texts) else "\0".join(t.replace("\0", " ") for t in texts).lower()
    x = np.frombuffer(f"\0{joined}\0".encode("utf-32-le", "replace"), "u4").copy()
    letter, edge = _letters()[x], x == 0
    x[~letter & ~edge] = 32
    keep = np.ones(len(x), bool)
    keep[1:] = letter[1:] | edge[1:] | letter[:-1]
    x, edge = x[keep], edge[keep]
    row = np.cumsum(edge) - 1
    x = np.where(edge, np.uint32(32), x)
    any_letter = np.bincount(row, x != 32, len(texts) + 1)[: len(texts)] > 0
    # An n-gram belongs to the row of its first character; none reaches beyond the next border.
    parts = [((row[: len(h)] << BITS) + h)[~edge[1 : len(h) + 1] if len(x) - len(h) == 2 else slice(None)] for h in _hashes(x)]
    total = np.bincount(np.concatenate(parts), minlength=(len(texts) + 1) << BITS)
    total = total[: len(texts) << BITS]
    at = np.flatnonzero(total)
    return at >> BITS, at & (DIM - 1), total[at], any_letter


def _groups(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and (i - start >= ROWS or size + len(t) > CHARS):
            yield start, texts[start:i]
            start, size = i, 0
        size += len(t)
    if texts:
        yield start, texts[start:]


def weigh(row: np.ndarray, feature: np.ndarray, count: np.ndarray, rows: int, idf: np.ndarray) -> np.ndarray:
    v = (1 + np.log(count)) * idf[feature]
    return v / np.sqrt(np.bincount(row, v * v, rows))[row]


def frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Texts that hold each feature, and the number of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIM + 1, "i8"), 0
        for batch in chunks(batches, "__raw"):
            for _, group in _groups([t.decode("utf-8", "replace") for t in batch.column("__raw").to_pylist()]):
                df[:DIM] += np.bincount(counts(group)[1], minlength=DIM)
                n += len(group)
        df[DIM] = n
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["f", "n"])

    got = map_arrow(texts.select("__raw"), run, "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(DIM + 1, "i8")
    out[np.array(got.column("f"), "i8")] = np.array(got.column("n"), "i8")
    return out[:DIM], int(out[DIM])


def fit(train: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray, np.ndarray, float] | None:
    """Languages, idf, weights (features x languages) and temperature from columns doc_id, lang, __raw."""
    sizes = {r["lang"]: r["count"] for r in train.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return None
    df, n = frequencies(train)
    idf = np.log((1 + n) / (1 + df)) + 1
    share = F.element_at(F.create_map(*(F.lit(v) for k in languages for v in (k, min(1.0, per_language / sizes[k])))), F.col("lang"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "__raw"):
            f, c = [], []
            for text in batch.column("__raw").to_pylist():
                _, feature, count, _ = counts([text.decode("utf-8", "replace")])
                f.append(feature.astype("u2").tobytes())
                c.append(np.minimum(count, (1 << 32) - 1).astype("u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("h"), pa.array(f, pa.binary()), pa.array(c, pa.binary())], ["lang", "h", "f", "c"])

    sample = train.filter(in_sample(share)).select("lang", F.xxhash64(F.col("doc_id").cast("string"), F.lit("fold")).alias("h"), "__raw")
    got = map_arrow(sample, features, "lang string, h long, f binary, c binary").toArrow().sort_by([("h", "ascending"), ("f", "ascending")])
    rows = []
    for f, c in zip(got.column("f").to_pylist(), got.column("c").to_pylist()):
        f, c = np.frombuffer(f, "u2").astype("i8"), np.frombuffer(c, "u4")
        v = weigh(np.zeros(len(f), "i8"), f, c, 1, idf)
        rows.append((np.append(f, DIM), np.append(v, 1.0)))
    y = np.array([languages.index(x) for x in got.column("lang").to_pylist()], "i8")
    back = np.array(got.column("h").to_pylist(), "i8") % 5 == 0 if len(rows) >= 50 else np.zeros(len(rows), bool)
    hot = np.eye(len(languages))
    x = Sparse.of([r for r, b in zip(rows, back) if not b])
    w = ftrl(x, hot[y[~back]], DIM + 1, alpha=0.5, l1=0.02, l2=0.1, epochs=2, free=DIM) if len(languages) > 1 else np.zeros((DIM + 1, 1))
    held = Sparse.of([r for r, b in zip(rows, back) if b])
    return languages, idf, w, temperature(held.dot(w), y[back])


def predict(documents: DataFrame, model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, lang_pred and score of every document."""
    df = documents.select(*keep, raw().alias("__raw"))
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in chunks(batches, "__raw"):
            name, score = [], []
            for _, group in _groups([t.decode("utf-8", "replace") for t in batch.column("__raw").to_pylist()]):
                row, feature, count, letter = counts(group)
                if model is None:
                    name += [UNKNOWN] * len(group)
                    score += [0.0] * len(group)
                    continue
                languages, idf, w, t = model
                v = weigh(row, feature, count, len(group), idf)
                s = np.stack([np.bincount(row, v * w[feature, c], len(group)) for c in range(len(languages))], 1) + w[DIM]
                p = softmax(s / t)
                best = p.argmax(1)
                name += [languages[b] if a else UNKNOWN for b, a in zip(best.tolist(), letter.tolist())]
                score += [float(q[b]) if a else 0.0 for q, b, a in zip(p, best.tolist(), letter.tolist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(name, pa.string()), pa.array(score, pa.float64())], [*keep, "lang_pred", "score"])

    return map_arrow(df, run, df.select(*keep).schema.add("lang_pred", "string").add("score", "double"))


def identify(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score; learns from rows whose crc32 remainder by 4 is not 2."""
    held = remainder(4) == 2
    train = documents.filter(~held & F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "lang", raw().alias("__raw"))
    return predict(documents.select("doc_id", held.alias("held_out"), "text"), fit(train), ("doc_id", "held_out"))
