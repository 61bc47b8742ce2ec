"""Hidden Markov language model: distributed Baum-Welch and exact forward likelihoods.

Tokens are the ASCII-lower-cased runs between blanks and one end per text. The ``SYMBOLS`` most frequent
training tokens are symbols of their own; every other token belongs to one of ``CLASSES`` open classes
by its length and make-up. A state emits a symbol or a class, and a class emits its token by smoothed
training counts, so that a token's probability is exact while the model that is broadcast has a fixed
size: (SYMBOLS + CLASSES) x STATES numbers, however large the corpus.

Training: token counts over all training texts, then ``ITERATIONS`` rounds of Baum-Welch. Each task runs
scaled forward-backward over its texts in blocks sorted by length and emits its expected counts, which
are summed by symbol. The texts' symbols are found once and kept, two bytes a token. A text above ``PIECE`` tokens is cut for speed only: products of its pieces' transfer
matrices give the forward variable that enters and the backward variable that leaves each piece, so that the
counts and likelihoods are those of the whole text. Scoring: one pass runs the scaled forward recursion on all
texts; counts of the rare tokens come by a join on the token, pre-aggregated per text, and one
aggregation per text sums up. Texts are known by doc_id and a hash, not by their place, so that a task that
is run again changes nothing.

Defined results: null and empty texts have the end alone; repeated rows have equal results and are returned as
often as they occur; an empty training set leaves the uniform model with N = V = 0; extra columns are
ignored; a null ``doc_id`` reads as the empty text in the split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.functions.durable import durable
from driftline.llm.arrowio import chunks, map_arrow, raw, remainder

STATES = 6
ITERATIONS = 3
CLASSES = 32
#: Symbols and classes together fit numbers of two bytes.
SYMBOLS = (1 << 16) - CLASSES
#: Tokens in one block of forward-backward, and in one piece of a text.
BLOCK = 400_000
PIECE = 512
#: Bins of token counts for each doubling, to find how many occurrences make a symbol.
PER_DOUBLING = 16
#: Steps between two scalings of a transfer matrix, few enough that no product vanishes.
RESCALE = 8
#: Added to each expected count, so that no symbol is impossible in a state.
PRIOR = 0.05
STAY = 0.95
CHUNK = 24 << 20

END = b""


def token_classes(names: pa.Array) -> np.ndarray:
    """The open class of each token."""
    letters = np.asarray(pc.ascii_is_alpha(names.view(pa.string())))
    return np.minimum(np.asarray(pc.binary_length(names)) >> 1, 15) + 16 * letters


def _class_column() -> F.Column:
    return F.least(F.shiftright(F.length("token"), 1), F.lit(15)) + F.when(F.col("token").cast("string").rlike("^[A-Za-z]+$"), 16).otherwise(0)


def tokenize(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct tokens of binary texts, all tokens by their place in these, and how many each text has."""
    # Only ASCII matters to these functions, so that the bytes need not be checked.
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.binary()).view(pa.string())))
    found = parts.flatten().dictionary_encode()
    names, codes = found.dictionary.view(pa.binary()), np.asarray(found.indices)
    # Blanks at either end of a text leave empty tokens; each text gets one, its end.
    end = pc.index(names, pa.scalar(END, pa.binary())).as_py()
    if end < 0:
        end, names = len(names), pa.concat_arrays([names, pa.array([END], pa.binary())])
    text = np.repeat(np.arange(len(texts)), np.asarray(pc.list_value_length(parts)))
    real = codes != end
    sizes = np.bincount(text[real], minlength=len(texts)) + 1
    out = np.empty(sizes.sum(), "i4")
    ends = np.cumsum(sizes) - 1
    inner = np.ones(len(out), bool)
    inner[ends] = False
    out[ends], out[inner] = end, codes[real]
    return names, out, sizes


def symbols_of(names: pa.Array, known: pa.Array) -> np.ndarray:
    """The symbol of each token: its place in ``known`` or, beyond these, its open class."""
    found = np.asarray(pc.index_in(names, known).fill_null(-1))
    return np.where(found < 0, len(known) + token_classes(names), found).astype("i4")


def token_counts(texts: DataFrame) -> DataFrame:
    """(token, c) over a binary column ``__raw``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "__raw"):
            names, codes, _ = tokenize(batch.column("__raw"))
            yield pa.RecordBatch.from_arrays([names, pa.array(np.bincount(codes, minlength=len(names)), pa.int64())], ["token", "c"])

    return map_arrow(texts.select("__raw"), run, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


class Block:
    """Sequences of symbols laid out step by step: those of step 0, then those of step 1 and so on."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        order = np.argsort(-sizes, kind="stable")
        starts = np.concatenate(([0], np.cumsum(sizes)))[order]
        self.order, self.sizes = order, sizes[order]
        self.active = len(sizes) - np.searchsorted(self.sizes[::-1], np.arange(1, self.sizes[0] + 1))
        self.offset = np.concatenate(([0], np.cumsum(self.active)))
        self.seq = np.repeat(np.arange(len(sizes)), self.sizes)
        step = np.arange(len(self.seq)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        self.place = self.offset[step] + self.seq
        self.x = np.empty(len(self.seq), flat.dtype)
        self.x[self.place] = flat[np.repeat(starts, self.sizes) + step]

    def forward(self, start: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scaled forward variables, in place of the emissions, and the scale of each step.

        ``start`` is the state distribution before the first step, one for all or one a sequence.
        """
        alpha = b[self.x]
        scale = np.empty(len(self.x), b.dtype)
        off = self.offset.tolist()
        ones = np.ones(len(a), b.dtype)
        cur = alpha[: off[1]]
        cur *= start if start.ndim == 1 else start[self.order]
        for t in range(len(off) - 1):
            lo, hi = off[t], off[t + 1]
            nxt = alpha[lo:hi]
            if t:
                nxt *= cur[: hi - lo] @ a
            s = scale[lo:hi]
            np.dot(nxt, ones, out=s)
            nxt /= s[:, None]
            cur = nxt
        return alpha, scale

    def transfer(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scaled matrices from the state before each sequence to the one at its end, and log10 of their scales."""
        off, k, n = self.offset.tolist(), len(a), len(self.sizes)
        # From, to, sequence: what is done to all sequences runs along the memory.
        emit, back = b.T.astype("f8")[:, self.x], a.T.astype("f8")
        out, moved, logs = np.zeros((k, k, n)), np.empty((k, k, n)), np.zeros(n)
        out[range(k), range(k)] = emit[:, : off[1]]

        def rescale(n: int) -> None:
            scale = out[:, :, :n].sum((0, 1))
            out[:, :, :n] /= scale
            logs[:n] += np.log10(scale)

        for t in range(1, len(off) - 1):
            lo, hi = off[t], off[t + 1]
            np.matmul(back, out[:, :, : hi - lo], out=moved[:, :, : hi - lo])
            np.multiply(moved[:, :, : hi - lo], emit[:, lo:hi], out=out[:, :, : hi - lo])
            if t % RESCALE == 0:
                rescale(hi - lo)
        rescale(n)
        given = np.empty_like(self.order)
        given[self.order] = np.arange(n)
        return out.transpose(2, 0, 1)[given], logs[given]

    def likelihoods(self, start: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """log10 probability of each sequence, in the order given."""
        _, scale = self.forward(start, a, b)
        sums = np.bincount(self.seq, np.log10(scale)[self.place], len(self.sizes))
        out = np.empty(len(sums))
        out[self.order] = sums
        return out

    def expect(self, start: np.ndarray, a: np.ndarray, b: np.ndarray, emit: np.ndarray, move: np.ndarray, begin: np.ndarray, first: np.ndarray | None = None, end: np.ndarray | None = None, enter: np.ndarray | None = None) -> float:
        """Add expected emission, transition and first-state counts; returns the log likelihood.

        For pieces of a text: ``first`` says which ones begin it, ``end`` is the backward variable at the
        end of each and ``enter`` the forward variable at the end of the piece before.
        """
        alpha, scale = self.forward(start, a, b)
        off = self.offset.tolist()
        last = np.ones((len(self.sizes), len(a)), b.dtype) if end is None else end[self.order].astype(b.dtype)
        e = b[self.x]
        e /= scale[:, None]
        beta = None
        for t in range(len(off) - 2, -1, -1):
            lo, hi = off[t], off[t + 1]
            n = 0 if beta is None else len(beta)
            if n:
                move += a * (alpha[lo : lo + n].T @ beta)
                back = beta @ a.T
                alpha[lo : lo + n] *= back
            beta = e[lo:hi]
            if n:
                beta[:n] *= back
            if n < hi - lo:
                # Both variables agree on the likelihood where a sequence ends.
                mine = last[n : hi - lo]
                mine /= np.einsum("ij,ij->i", alpha[lo + n : hi], mine)[:, None]
                alpha[lo + n : hi] *= mine
                beta[n:] *= mine
        if first is None:
            begin += alpha[: off[1]].sum(0)
        else:
            head = first[self.order]
            begin += alpha[: off[1]][head].sum(0)
            move += a * (enter[self.order][~head].T @ beta[~head])
        for k in range(len(a)):
            emit[:, k] += np.bincount(self.x, alpha[:, k], len(emit))
        return float(np.log10(scale).sum())


def _blocks(seqs: list[np.ndarray], limit: int = BLOCK) -> Iterator[tuple[list[int], Block]]:
    """Sequences sorted by length, in blocks of about ``limit`` steps."""
    order = sorted(range(len(seqs)), key=lambda i: -len(seqs[i]))
    held: list[int] = []
    size = 0
    for i in order:
        if held and size + len(seqs[i]) > limit:
            yield held, Block(np.concatenate([seqs[j] for j in held]), np.array([len(seqs[j]) for j in held]))
            held, size = [], 0
        held.append(i)
        size += len(seqs[i])
    if held:
        yield held, Block(np.concatenate([seqs[j] for j in held]), np.array([len(seqs[j]) for j in held]))


class Pieces:
    """Texts as pieces of at most ``PIECE`` tokens, with what passes between them under a model."""

    def __init__(self, texts: list[np.ndarray], pi: np.ndarray, a: np.ndarray, b: np.ndarray, piece: int | None = None) -> None:
        piece = piece or PIECE
        self.model = pi, a, b
        self.seqs = [x[k : k + piece] for x in texts for k in range(0, len(x), piece)]
        self.text = np.repeat(np.arange(len(texts)), [-(-len(x) // piece) for x in texts])
        n, k = len(self.seqs), len(a)
        self.first = np.concatenate(([True], self.text[1:] != self.text[:-1])) if n else np.empty(0, bool)
        self.last = np.append(self.first[1:], True) if n else np.empty(0, bool)
        self.start, self.enter = np.tile(pi.astype("f8"), (n, 1)), np.ones((n, k))
        #: log10 probability of the pieces that another one follows, given what is before them.
        self.passed = np.zeros(n)
        self.through = np.empty((n, k, k))
        self._transfer(np.flatnonzero(~self.last), self.passed)
        at = a.astype("f8")
        for j in np.flatnonzero(~self.last).tolist():
            out = self.start[j] @ self.through[j]
            total = out.sum()
            self.passed[j] += np.log10(total)
            self.enter[j + 1] = out / total
            self.start[j + 1] = self.enter[j + 1] @ at

    def _transfer(self, pieces: np.ndarray, logs: np.ndarray) -> None:
        _, a, b = self.model
        for held, block in _blocks([self.seqs[j] for j in pieces.tolist()]):
            self.through[pieces[held]], logs[pieces[held]] = block.transfer(a, b)

    def likelihoods(self, texts: int) -> np.ndarray:
        """log10 probability of each text."""
        _, a, b = self.model
        out, last = self.passed.copy(), np.flatnonzero(self.last)
        for held, block in _blocks([self.seqs[j] for j in last.tolist()]):
            out[last[held]] = block.likelihoods(self.start[last[held]].astype(b.dtype), a, b)
        return np.bincount(self.text, out, texts)

    def _ends(self) -> np.ndarray:
        """The backward variable at the end of each piece."""
        end, at = np.ones((len(self.seqs), len(self.model[1]))), self.model[1].astype("f8")
        self._transfer(np.flatnonzero(self.last & ~self.first), np.empty(len(self.seqs)))
        for j in np.flatnonzero(~self.last)[::-1].tolist():
            out = at @ (self.through[j + 1] @ end[j + 1])
            end[j] = out / out.sum()
        return end

    def expect(self, emit: np.ndarray, move: np.ndarray, begin: np.ndarray) -> float:
        _, a, b = self.model
        fit, end = 0.0, self._ends()
        for held, block in _blocks(self.seqs):
            fit += block.expect(self.start[held].astype(b.dtype), a, b, emit, move, begin, self.first[held], end[held], self.enter[held])
        return fit


def frequent(counts: DataFrame, symbols: int) -> DataFrame:
    """At most ``symbols`` tokens: all that occur at least so often, and the end of texts.

    A histogram of counts in steps of 1 / ``PER_DOUBLING`` of a doubling finds how often, so that no task sorts tokens.
    """
    bin_ = F.floor(F.log2(F.col("c").cast("double")) * PER_DOUBLING).cast("int")
    sizes = sorted(counts.groupBy(bin_.alias("b")).count().collect(), reverse=True)
    total, cut = 1, 1 << 30
    for b, n in sizes:
        total += n
        if total > symbols:
            break
        cut = b
    return counts.filter((bin_ >= cut) | (F.length("token") == 0))


def score(documents: DataFrame, held_out: F.Column | None = None, states: int = STATES, iterations: int = ITERATIONS, symbols: int = SYMBOLS, seed: int = 7) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    spark = documents.sparkSession
    sc = spark.sparkContext
    held_out = held_out if held_out is not None else remainder(10) == 0
    docs = documents.select("doc_id", held_out.alias("held_out"), F.xxhash64("doc_id", raw()).alias("h"), raw().alias("__raw"))
    train = docs.filter(~F.col("held_out")).select("__raw")

    counts = durable(token_counts(train))
    n_all, v_all = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    head = sorted(frequent(counts, symbols).toArrow().to_pylist(), key=lambda r: (-r["c"], r["token"]))
    names, top = [r["token"] for r in head], np.array([r["c"] for r in head], "i8")
    known_names = pa.array(names, pa.binary())
    # What the open classes hold: all of a class less its symbols.
    per_class = np.zeros((CLASSES, 2))
    for c, total, distinct in counts.filter(F.length("token") > 0).groupBy(_class_column()).agg(F.sum("c"), F.count("*")).collect():
        per_class[c] = total, distinct
    for t, k, c in zip(names, token_classes(known_names).tolist(), top):
        if t:
            per_class[k] -= c, 1
    class_mass = per_class[:, 0] + 0.1 * (per_class[:, 1] + 1)
    n_symbols = len(names) + CLASSES

    rng = np.random.default_rng(seed)
    seen = np.concatenate((top, per_class[:, 0])) + PRIOR
    emit = seen[:, None] * rng.uniform(0.5, 1.5, (n_symbols, states))
    b = emit / emit.sum(0)
    # States start out lasting, so that the first rounds sort texts, not single words, among them.
    a = STAY * np.eye(states) + (1 - STAY) / states
    pi = np.full(states, 1 / states)
    shared_names = sc.broadcast(known_names)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "__raw"):
            tokens, codes, sizes = tokenize(batch.column("__raw"))
            found = symbols_of(tokens, shared_names.value).astype(kind)[codes]
            ends = np.concatenate(([0], np.cumsum(sizes) * found.itemsize)).astype("i4")
            packed = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(found)])
            yield pa.RecordBatch.from_arrays([packed], ["ids"])

    kind = "<u2" if n_symbols <= 1 << 16 else "<i4"
    sequences = durable(map_arrow(train, numbered, "ids binary")) if n_all and iterations else None

    def e_step(model) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, (pi, a, b) = n_symbols, (x.astype("f4") for x in model.value)
            emit, move, begin, fit, steps = np.zeros((n, len(pi))), np.zeros((len(pi), len(pi))), np.zeros(len(pi)), 0.0, 0
            for batch in chunks(batches, "ids", CHUNK // 4):
                seqs = [np.frombuffer(x, kind).astype("i4") for x in batch.column("ids").to_pylist()]
                fit += Pieces(seqs, pi, a, b).expect(emit, move, begin)
                steps += sum(map(len, seqs))
            if not steps:
                return
            rows = np.flatnonzero(emit.any(1))
            # Below 0: -1 first states and fit, from -2 on the transitions of each state.
            keys = np.concatenate((rows, -2 - np.arange(len(pi)), [-1]))
            values = np.concatenate((emit[rows], move, [begin]))
            fits = np.zeros(len(keys))
            fits[-1] = fit
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *(pa.array(values[:, k]) for k in range(len(pi))), pa.array(fits)], ["sym", *(f"e{k}" for k in range(len(pi))), "fit"])

        columns = [f"e{k}" for k in range(states)] + ["fit"]
        parts = map_arrow(sequences, run, "sym long, " + ", ".join(f"{c} double" for c in columns))
        return parts.groupBy("sym").agg(*(F.sum(c).alias(c) for c in columns))

    for _ in range(iterations if n_all else 0):
        model = sc.broadcast((pi, a, b))
        got = e_step(model).toArrow()
        key = np.array(got.column("sym"))
        val = np.stack([np.array(got.column(f"e{k}")) for k in range(states)], 1)
        emit = np.full((n_symbols, states), PRIOR)
        emit[key[key >= 0]] += val[key >= 0]
        b = emit / emit.sum(0)
        move = np.full((states, states), PRIOR)
        move[-2 - key[key < -1]] += val[key < -1]
        a = move / move.sum(1, keepdims=True)
        first = val[key == -1].sum(0) + PRIOR
        pi = first / first.sum()
        model.unpersist()

    denom = n_all + 0.1 * (v_all + 1)
    final = sc.broadcast((pi, a, b, np.log10((top + 0.1) / denom)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_names, (pi, a, b, base) = shared_names.value, final.value
        base = np.append(base, np.zeros(CLASSES))
        for batch in chunks(batches, "__raw", CHUNK):
            tokens, codes, sizes = tokenize(batch.column("__raw"))
            found = symbols_of(tokens, known_names)[codes]
            n, starts = len(sizes), np.cumsum(sizes) - sizes
            fit = Pieces(np.split(found, starts[1:]), pi, a, b).likelihoods(n)
            known = np.add.reduceat(found < len(known_names), starts, dtype="i8")
            known_base = np.add.reduceat(base[found], starts)
            # Tokens that are no symbols, once a text.
            rare = np.flatnonzero(found >= len(known_names))
            pairs, tfs = np.unique(np.repeat(np.arange(n), sizes)[rare] << 32 | codes[rare], return_counts=True)
            m = len(pairs)
            blank = lambda kind: pa.nulls(m, kind)
            own, place = pa.array([b" %d" % k for k in batch.column("h").to_pylist()], pa.binary()), pa.array(np.append(np.arange(n), pairs >> 32), pa.int32())
            columns = {
                "h": batch.column("h").take(place),
                "doc_id": batch.column("doc_id").take(place),
                # A row for the text itself joins to nothing: no token holds a blank.
                "token": pa.concat_arrays([own, tokens.take(pa.array(pairs & 0xFFFFFFFF))]),
                "tf": pa.array(np.append(np.zeros(n, "i8"), tfs), pa.int64()),
                "held_out": pa.concat_arrays([batch.column("held_out"), blank(pa.bool_())]),
                "n": pa.concat_arrays([pa.array(sizes, pa.int64()), blank(pa.int64())]),
                "known": pa.concat_arrays([pa.array(known, pa.int64()), blank(pa.int64())]),
                "base": pa.concat_arrays([pa.array(known_base), blank(pa.float64())]),
                "fit": pa.concat_arrays([pa.array(fit), blank(pa.float64())]),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    id_type = documents.schema["doc_id"].dataType.simpleString()
    rows = map_arrow(docs, scan, f"h long, doc_id {id_type}, token binary, tf long, held_out boolean, n long, known long, base double, fit double")
    c = F.coalesce("c", F.lit(0)) + 0.1
    mass = F.get(F.array(*(F.lit(float(x)) for x in class_mass)), _class_column())
    joined = rows.join(counts, "token", "left")
    # Equal rows come together; what is summed counts each of them.
    times = F.count("n")
    per = joined.groupBy("doc_id", "h").agg(
        times.alias("times"),
        F.max("held_out").alias("held_out"),
        F.max("n").alias("n_tokens"),
        (F.max("known") + (F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)) / times).cast("long")).alias("n_known"),
        (F.max("base") + F.sum(F.when(F.col("tf") > 0, F.col("tf") * F.log10(c / F.lit(float(denom)))).otherwise(0.0)) / times).alias("base_score"),
        (F.max("fit") + F.sum(F.when(F.col("tf") > 0, F.col("tf") * F.log10(c / mass)).otherwise(0.0)) / times).alias("score"),
    )
    per = per.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    return per.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(n_all)).cast("long").alias("train_tokens"), "base_score", "score")
