"""Secret scan: named patterns plus a battery of randomness tests, all in Spark SQL expressions.

Base findings are the leftmost non-overlapping matches of three patterns; those too short are dropped.
The battery looks at every run of ``MIN_RUN`` or more encoding characters. From the characters it infers
an encoding (decimal, hex, base32, one-case letters, letters and digits or base64), maps the run to
digits of that alphabet and computes

* chi-squared of the digit counts against uniformity, a rising function of the pairs of equal digits,
* a Wald-Wolfowitz runs test of digits below and above the middle,
* the lag-1 serial correlation.

A random run passes all three (|z| up to ``PASS_Z``). Against that stands the hypothesis of structured text:
digits and neighbours as frequent as in the corpus's own tokens of ``SHORT`` to ``MIN_RUN`` - 1 encoding characters, which
a first pass counts (a table of 64 x 64 pairs; ``PRIOR`` pairs of a general order of letters stand in where the
corpus has few). For a text-like run this gives the mean and spread of all three statistics, exactly for the
number of equal pairs; each z says how far the run is from text, and they are combined with weights by how far
a random run of that length would be from text (Stouffer), so that evidence grows with length and a test
that cannot tell the two apart in an alphabet has no say. Within each band of lengths, the Benjamini-Hochberg rule
over all runs of the corpus picks the z at which at most a share ``FDR`` of the accepted runs is expected
to be text.

Scale: no join and no shuffle of texts. Two passes aggregate tables of fixed size (64 x 64; bands times z
bins), a third emits the findings. Positions and cuts come from running sums over the pieces between matches,
in blocks of ``STEP``, so that a text with very many matches stays near linear.

Defined results: null and empty texts have no findings; the digest is then of no bytes; one-character
runs and texts without a run give none; repeated rows give repeated results; extra columns are ignored or, in
``redact``, returned as they were, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The patterns of the base findings, in the order of their kinds.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")

MIN_RUN = 20
RUN = r"[A-Za-z0-9+/_=-]{%d,}" % MIN_RUN
PASS_Z = 3.3
FDR = 0.05
STEP = 200
#: Lower ends of the bands of lengths.
BANDS = (20, 28, 40, 56, 80, 128)
#: Histogram bins of z_text: from 0 in steps of 1/8 up to 16.
BINS, PER_UNIT = 128, 8

_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
#: name, pattern, alphabet.
ENCODINGS = (
    ("decimal", "^[0-9]+$", "0123456789"),
    ("hex", "^[0-9a-f]+$", "0123456789abcdef"),
    ("HEX", "^[0-9A-F]+$", "0123456789ABCDEF"),
    ("lower", "^[a-z]+$", "abcdefghijklmnopqrstuvwxyz"),
    ("upper", "^[A-Z]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base32", "^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("alnum", "^[0-9A-Za-z]+$", _DIGITS[:62]),
    ("base64", "", _DIGITS),
)
#: Letters from frequent to rare in general text, for a corpus of which little is known: the r-th weighs 1 / r.
_ORDER = "etaoinsrhldcumfpgwybvkxjqz"
PRIOR = 500
SHORT = 8


def _matches(text: Column, pattern: str, group: int | None = None) -> Column:
    """array<struct<start, end, body>> of the leftmost non-overlapping matches, in code points."""
    pieces = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    body = whole if group is None else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    pairs = F.zip_with(F.slice(pieces, 1, F.size(whole)), F.zip_with(whole, body, lambda w, b: F.struct(w.alias("w"), b.alias("b"))), lambda p, m: F.struct(F.length(p).cast("long").alias("gap"), F.length(m["w"]).cast("long").alias("n"), m["b"].alias("body")))
    found = F.struct(F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"), F.lit("").alias("body"))
    none = F.slice(F.array(found), 1, 0)

    def place(block: Column, at: Column) -> Column:
        """The matches of one block that begins at ``at``."""
        state = F.struct(at.alias("at"), none.alias("out"))
        return F.aggregate(block, state, lambda s, m: F.struct((s["at"] + m["gap"] + m["n"]).alias("at"), F.concat(s["out"], F.array(F.struct((s["at"] + m["gap"]).alias("start"), (s["at"] + m["gap"] + m["n"]).alias("end"), m["body"].alias("body")))).alias("out")))["out"]

    def located(pairs: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(pairs), F.lit(1)), F.lit(STEP))
        return let(F.transform(starts, lambda k: F.slice(pairs, k, STEP)), joined)

    def joined(blocks: Column) -> Column:
        sizes = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda a, m: a + m["gap"] + m["n"]))
        return F.flatten(let(sizes, lambda z: F.zip_with(blocks, F.transform(z, lambda _, k: F.aggregate(F.slice(z, 1, k), F.lit(0).cast("long"), lambda a, x: a + x)), place)))

    return F.when(text.rlike(pattern), let(pairs, located)).otherwise(none)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _tagged(found: Column, kind: int, keep=None) -> Column:
    kept = found if keep is None else F.filter(found, keep)
    return F.transform(kept, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end")))


def neighbours(documents: DataFrame) -> np.ndarray:
    """How often each of the 64 digits follows each in the corpus's tokens too short to be tested."""
    token = F.filter(F.regexp_extract_all(_text(), F.lit("[A-Za-z0-9+/_=-]{%d,}" % SHORT), F.lit(0)), lambda t: F.length(t) < MIN_RUN)
    core = documents.select(F.explode(token).alias("t")).select(F.translate("t", "-_=", "+/").alias("t"))
    pairs = core.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("t") - 1), lambda k: F.substring("t", k, F.lit(2)))).alias("p"))
    out = np.zeros((64, 64))
    for pair, n in pairs.groupBy("p").count().collect():
        if len(pair) == 2:
            out[_DIGITS.index(pair[0]), _DIGITS.index(pair[1])] += n
    return out


def text_model(seen: np.ndarray) -> list[tuple[float, float, float, float]]:
    """For each encoding, of its digits in text: the sums of the squares and cubes of their frequencies, the
    chance that neighbours lie on either side of the middle, and the correlation of neighbours."""
    one = np.full(64, 0.01)
    for r, c in enumerate(_ORDER):
        one[_DIGITS.index(c)] = 1 / (1 + r)
        one[_DIGITS.index(c.upper())] = 0.05 / (1 + r)
    pair = seen + PRIOR * np.outer(one, one) / one.sum() ** 2
    out = []
    for _, _, alphabet in ENCODINGS:
        at = [_DIGITS.index(c) for c in alphabet]
        p = pair[np.ix_(at, at)] + 1e-6
        p /= p.sum()
        f, g, x = p.sum(1), p.sum(0), np.arange(1, len(at) + 1)
        both = (f + g) / 2
        high = x > (len(at) + 1) / 2
        cov = x @ p @ x - (f @ x) * (g @ x)
        spread = np.sqrt((f @ x**2 - (f @ x) ** 2) * (g @ x**2 - (g @ x) ** 2))
        out.append((float((both**2).sum()), float((both**3).sum()), float(p[high != high[:, None]].sum()), float(cov / spread)))
    return out


def _battery(run: Column, text: list[tuple[float, float, float, float]]) -> Column:
    """struct<n, ok, z> of one run: its length, whether it passes as random, and how far it is from text."""
    core = F.translate(F.regexp_replace(run, "=+$", ""), "-_", "+/")
    which = F.lit(len(ENCODINGS) - 1)
    for e in range(len(ENCODINGS) - 2, -1, -1):
        which = F.when(core.rlike(ENCODINGS[e][1]), e).otherwise(which)
    table = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(float(len(a))).alias("k"), *(F.lit(v).alias(name) for name, v in zip(("s2", "s3", "q", "rho"), m))) for (_, _, a), m in zip(ENCODINGS, text)))

    def measured(enc: Column) -> Column:
        return F.transform(F.filter(F.split(core, ""), lambda c: c != ""), lambda c: F.instr(enc["a"], c).cast("double"))

    def tests(enc: Column, x: Column) -> Column:
        n, k = F.size(x).cast("double"), enc["k"]
        mean = F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / n
        mid = (k + 1) / 2
        # Sum of squared counts: the r-th equal digit in order adds 2r-1.
        zero = F.struct(F.lit(-1.0).alias("v"), F.lit(0.0).alias("r"), F.lit(0.0).alias("s"))
        squares = F.aggregate(F.array_sort(x), zero, lambda s, v: F.when(s["v"] == v, F.struct(v.alias("v"), (s["r"] + 1).alias("r"), (s["s"] + 2 * s["r"] + 1).alias("s"))).otherwise(F.struct(v.alias("v"), F.lit(1.0).alias("r"), (s["s"] + 1).alias("s"))))["s"]
        start = F.struct(F.lit(0.0).alias("v"), F.lit(0.0).alias("runs"), F.lit(0.0).alias("high"), F.lit(0.0).alias("var"), F.lit(0.0).alias("cov"))
        order = F.aggregate(
            x,
            start,
            lambda s, v: F.struct(
                v.alias("v"),
                (s["runs"] + F.when((s["v"] == 0) | ((s["v"] > mid) != (v > mid)), 1.0).otherwise(0.0)).alias("runs"),
                (s["high"] + F.when(v > mid, 1.0).otherwise(0.0)).alias("high"),
                (s["var"] + (v - mean) * (v - mean)).alias("var"),
                (s["cov"] + F.when(s["v"] == 0, 0.0).otherwise((s["v"] - mean) * (v - mean))).alias("cov"),
            ),
        )
        return F.struct(n.alias("n"), squares.alias("squares"), order.alias("o"), enc.alias("e"))

    def verdict(t: Column) -> Column:
        n, k, high, e = t["n"], t["e"]["k"], t["o"]["high"], t["e"]
        low = n - high
        chi = k / n * t["squares"] - n
        z_chi = (F.pow(chi / (k - 1), 1 / 3) - (1 - 2 / (9 * (k - 1)))) / F.sqrt(2 / (9 * (k - 1)))
        expected = 2 * high * low / n + 1
        var = (expected - 1) * (expected - 2) / (n - 1)
        z_runs = F.when(var > 0, (t["o"]["runs"] - expected) / F.sqrt(var)).otherwise(F.lit(99.0))
        serial = t["o"]["cov"] / t["o"]["var"] + 1 / n
        z_serial = F.when(t["o"]["var"] > 0, serial * F.sqrt(n)).otherwise(F.lit(99.0))
        ok = (z_chi <= PASS_Z) & (F.abs(z_runs) <= PASS_Z) & (F.abs(z_serial) <= PASS_Z)
        # Against text: ordered pairs of equal digits, changes of side, serial correlation.
        equal, pairs = t["squares"] - n, n * (n - 1)
        wide = F.sqrt(F.greatest(2 * pairs * (e["s2"] + 2 * (n - 2) * e["s3"] - (2 * n - 3) * e["s2"] * e["s2"]), F.lit(1e-9)))
        side = F.sqrt((n - 1) * e["q"] * (1 - e["q"]))
        above = F.floor(k / 2) / k
        z = F.array((equal - pairs * e["s2"]) / wide, (t["o"]["runs"] - 1 - (n - 1) * e["q"]) / side, (serial - e["rho"]) * F.sqrt(n))
        random = F.array((pairs / k - pairs * e["s2"]) / wide, (2 * above * (1 - above) - e["q"]) * (n - 1) / side, -e["rho"] * F.sqrt(n))
        dot = lambda a, b: a[0] * b[0] + a[1] * b[1] + a[2] * b[2]
        return F.struct(n.cast("int").alias("n"), ok.alias("ok"), F.when(ok, let(random, lambda r: dot(r, z) / F.sqrt(dot(r, r) + 1e-9))).otherwise(0.0).alias("z"))

    return let(F.get(table, which), lambda enc: let(measured(enc), lambda x: let(tests(enc, x), verdict)))


def _band(n: Column) -> Column:
    out = F.lit(0)
    for k, low in enumerate(BANDS):
        out = F.when(n >= low, k).otherwise(out)
    return out


def runs(text: list[tuple[float, float, float, float]]) -> Column:
    """array<struct<start, end, t>> of the tested runs of ``text``; ``t`` is what the battery says."""
    return F.transform(_matches(_text(), RUN), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), _battery(m["body"], text).alias("t")))


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def thresholds(documents: DataFrame, text: list[tuple[float, float, float, float]], fdr: float = FDR) -> list[float]:
    """The least z accepted in each band of lengths, by Benjamini-Hochberg over all runs."""
    t = documents.select(F.explode(runs(text)).alias("r")).select("r.t.*")
    bin_ = F.when(F.col("ok"), F.least(F.greatest(F.floor(F.col("z") * PER_UNIT), F.lit(0)), F.lit(BINS - 1)).cast("int")).otherwise(0)
    counts = {(b, z): n for b, z, n in t.groupBy(_band(F.col("n")).alias("b"), bin_.alias("z")).count().collect()}
    out = []
    for b in range(len(BANDS)):
        total, above, best = sum(n for (k, _), n in counts.items() if k == b), 0, 1e9
        for z in range(BINS - 1, 7, -1):
            above += counts.get((b, z), 0)
            if above and total * math.erfc(z / PER_UNIT / math.sqrt(2)) / 2 <= fdr * above:
                best = z / PER_UNIT
        out.append(best)
    return out


def findings(documents: DataFrame, fdr: float = FDR) -> DataFrame:
    """All columns of ``documents`` and the arrays ``__base`` and ``__spans`` of (start, kind, end)."""
    texts = documents.select("text")
    text = text_model(neighbours(texts))
    least = thresholds(texts, text, fdr)
    base = F.array_sort(F.concat(_tagged(_matches(_text(), ASSIGN, 2), 0, lambda m: F.length(m["body"]) >= 6), _tagged(_matches(_text(), ACCESS), 1), _tagged(_matches(_text(), HEX), 2)))
    limit = lambda n: F.get(F.array(*map(F.lit, least)), _band(n))
    added = F.filter(runs(text), lambda r: r["t"]["ok"] & (r["t"]["z"] >= limit(r["t"]["n"])))
    df = documents.withColumns({"__base": base, "__added": added})
    free = F.filter("__added", lambda r: ~F.exists("__base", lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"])))
    more = F.transform(free, lambda r: F.struct(r["start"].alias("start"), F.lit(3).alias("kind"), r["end"].alias("end")))
    return df.withColumn("__spans", F.array_sort(F.concat("__base", more))).drop("__added")


def _listed(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def report(documents: DataFrame, fdr: float = FDR) -> DataFrame:
    """doc_id, counts by kind, digest of the base findings and the list of all spans."""
    df = findings(documents.select("doc_id", "text"), fdr)
    n = lambda kind: F.size(F.filter("__base", lambda b: b["kind"] == kind)).cast("long")
    return df.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(_listed("__base"), 256).alias("base_sha256"), _listed("__spans").alias("spans"))


def _marked(text: Column, spans: Column, mark: str) -> Column:
    """``text`` with ``mark`` in place of each span; of overlapping ones, for all of them once.

    The spans of a block are cut from the part of the text that they lie in.
    """
    none = F.slice(F.array(F.lit("")), 1, 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size(spans), F.lit(1)), F.lit(STEP))
    last = lambda block: F.aggregate(block, F.lit(0).cast("long"), lambda a, m: F.greatest(a, m["end"]))

    def cut(block: Column, start: Column) -> Column:
        def within(part: Column) -> Column:
            state = F.struct(start.alias("at"), none.alias("out"))
            piece = lambda s, m: F.array(part.substr((s["at"] - start + 1).cast("int"), (m["start"] - s["at"]).cast("int")), F.lit(mark))
            return F.array_join(F.aggregate(block, state, lambda s, m: F.struct(F.greatest(s["at"], m["end"]).alias("at"), F.when(m["start"] >= s["at"], F.concat(s["out"], piece(s, m))).otherwise(s["out"]).alias("out")))["out"], "")

        return let(text.substr((start + 1).cast("int"), F.greatest(last(block) - start, F.lit(0)).cast("int")), within)

    def joined(blocks: Column) -> Column:
        ends = F.transform(blocks, last)
        before = let(ends, lambda z: F.transform(z, lambda _, k: F.aggregate(F.slice(z, 1, k), F.lit(0).cast("long"), lambda a, x: F.greatest(a, x))))
        return F.concat(F.array_join(F.zip_with(blocks, before, cut), ""), text.substr((last(spans) + 1).cast("int"), F.length(text)))

    return let(F.transform(starts, lambda k: F.slice(spans, k, STEP)), joined)


def redact(documents: DataFrame, fdr: float = FDR, mark: str = "[SECRET]") -> DataFrame:
    """The documents in their own columns, every found span replaced by ``mark``; others unchanged."""
    columns = documents.columns
    df = findings(documents.select(F.struct(*columns).alias("__row"), "text"), fdr)
    clean = F.when(F.size("__spans") > 0, _marked(F.col("text"), F.col("__spans"), mark)).otherwise(F.col("text"))
    return df.select(*(clean.alias(c) if c == "text" else F.col("__row")[c].alias(c) for c in columns))
