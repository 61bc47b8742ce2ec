"""Byte-pair encoding by backtracking over longest matches, and decoding by an offset table.

A word is a string of atoms: one character for each UTF-8 byte, its last byte marked as a word end. An
Aho-Corasick automaton over the vocabulary's atom strings gives the longest token at each place. The
encoder takes it if it is compatible with the token before it, else the next shorter token that is a
prefix of it, else steps back one token; a bit per place marks dead ends, so that each place is tried
once. Two tokens are compatible if merging their concatenation by rank would leave that border standing;
the answers are kept in a bounded table. The result is exactly the ranked merges' one.

Normalisation, as in the tokenizer's file: the special tokens are split off first; then NFC, white space
to one blank, each character lower-cased alone; then words by pattern. The tables of Unicode behind this
differ in age between Python and the tokenizers library: the driver compares both on every assigned
character, and texts with one that the two read differently, or that Python's tables don't know, are cut into
words by the library's normaliser and pre-tokenizer. Decoding without a decoder joins the token strings with blanks.

Scale: one Arrow pass, no shuffle, with a broadcast of 136 KB for the odd characters. The vocabulary is loaded once per Python process from its path, which
every executor must see, as for any installed package. Caches are bounded.

Defined results: null and empty texts have no tokens and decode to the empty text; the digests are then
those of no bytes. Extra columns are ignored; repeated rows give repeated results.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.arrowio import chunks, map_arrow, raw

#: Distinct words whose ids a worker remembers, in each of two generations; the older one goes when the
#: younger is full.
CACHE_WORDS = 400_000
#: Token pairs whose compatibility a worker remembers.
CACHE_PAIRS = 400_000

def byte_characters() -> list[str]:
    """The usual printable stand-in for each byte: itself if it is visible Latin-1, else from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = iter(range(256, 512))
    return [chr(b) if b in seen else chr(next(extra)) for b in range(256)]


def library_of(path: str):
    """The tokenizers library's normaliser and pre-tokenizer of a file, without its vocabulary."""
    from tokenizers import Tokenizer as Library

    spec = json.loads(open(path, encoding="utf-8").read())
    # What the normaliser and pre-tokenizer do does not depend on the model.
    spec["model"] = {"type": "BPE", "vocab": {}, "merges": []}
    spec["added_tokens"], spec["post_processor"] = [], None
    return Library.from_str(json.dumps(spec))


def _split_pattern(spec: dict) -> str:
    return next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")


def odd_characters(path: str) -> bytes:
    """A bit for each code point: whether Python and the tokenizers library may read it differently."""
    if path not in _ODD:
        library, byte_of = library_of(path), {c: b for b, c in enumerate(byte_characters())}
        pattern = regex.compile(_split_pattern(json.loads(open(path, encoding="utf-8").read())))
        pieces = lambda t: [bytes(byte_of[x] for x in p) for p, _ in library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(t))]
        own = lambda t: [p.encode() for p in pattern.findall(Tokenizer.normal(t))]
        odd = np.zeros(0x110000, bool)
        for start in range(0, 0x110000, 4096):
            known = []
            for c in range(start, start + 4096):
                if not 0xD800 <= c < 0xE000:
                    odd[c] = unicodedata.category(chr(c)) in ("Cn", "Co")
                    if not odd[c]:
                        known.append(c)
            # Each character stands between letters. Blocks that agree as a whole need no closer look.
            text = " ".join(f"a{chr(c)}b" for c in known)
            if pieces(text) != own(text):
                for c in known:
                    odd[c] = pieces(f"a{chr(c)}b") != own(f"a{chr(c)}b")
        _ODD[path] = np.packbits(odd).tobytes()
    return _ODD[path]


_ODD: dict[str, bytes] = {}


class Tokenizer:
    """A vocabulary with ranked merges and a word-end suffix, read from a tokenizers JSON file."""

    def __init__(self, path: str) -> None:
        import ahocorasick

        spec = json.loads(open(path, encoding="utf-8").read())
        model = spec["model"]
        suffix, vocab = model["end_of_word_suffix"], model["vocab"]
        self.pattern = regex.compile(_split_pattern(spec))
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special, self.path = special, path
        self.odd: np.ndarray | None = None
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None

        chars = byte_characters()
        self.byte_of = byte_of = {c: b for b, c in enumerate(chars)}

        def atoms(token: str) -> str:
            ends = token.endswith(suffix) and len(token) > len(suffix)
            body = [byte_of[c] for c in (token[: -len(suffix)] if ends else token)]
            return "".join(chr(b + 256 * (ends and k == len(body) - 1)) for k, b in enumerate(body))

        # A token's rank: atoms come before all merges, merges in their order.
        self.atom_id = {}
        by_atoms: dict[str, int] = {}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        made = {a + b for a, b in merges}
        rank: dict[int, int] = {}
        for token, i in vocab.items():
            if token not in made:
                a = atoms(token)
                if len(a) == 1:
                    self.atom_id[a] = i
                    by_atoms[a] = i
                    rank[i] = len(rank) - len(vocab)
        self.pair: dict[tuple[int, int], int] = {}
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        for k, (a, b) in enumerate(merges):
            i = vocab[a + b]
            self.pair.setdefault((vocab[a], vocab[b]), i)
            if i not in rank:
                rank[i], self.left[i], self.right[i] = k, vocab[a], vocab[b]
                by_atoms[atoms(a + b)] = i
        self.rank = rank
        self.size = {i: len(a) for a, i in by_atoms.items()}
        self.trie = ahocorasick.Automaton()
        for a, i in by_atoms.items():
            self.trie.add_word(a, i)
        self.trie.make_automaton()
        self.by_atoms = by_atoms
        self.longest = max(map(len, by_atoms))
        # The longest token that is a proper prefix of each token.
        self.shorter: dict[int, int] = {}
        for a, i in by_atoms.items():
            for n in range(len(a) - 1, 0, -1):
                if (j := by_atoms.get(a[:n])) is not None:
                    self.shorter[i] = j
                    break

        names = {i: t for t, i in vocab.items()} | {i: t for t, i in special.items()}
        pieces = [names.get(i, "").encode() + b" " for i in range(max(names) + 1)]
        self.offsets = np.concatenate(([0], np.cumsum([len(p) for p in pieces]))).astype("i8")
        self.table = np.frombuffer(b"".join(pieces), "u1")
        self._theirs = None
        self._word: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        self._fits: dict[tuple[int, int], bool] = {}

    def fits(self, a: int, b: int) -> bool:
        """Whether the border between the neighbours a and b outlives all merges."""
        key = (a, b)
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) >= CACHE_PAIRS:
                self._fits.clear()
            known = self._fits[key] = self._border_stands(a, b)
        return known

    def _border_stands(self, a: int, b: int) -> bool:
        """Unmerge from the highest rank down, on the side that was merged last; any merge across the
        border that ranks before the merges still to come would have happened first."""
        pair, rank, left, right = self.pair, self.rank, self.left, self.right
        limit = len(rank)
        while True:
            across = pair.get((a, b))
            if across is not None and rank[across] < limit:
                return False
            split_a, split_b = a in right, b in left
            if not split_a and not split_b:
                return True
            if split_a and (not split_b or rank[a] > rank[b]):
                limit, a = rank[a], right[a]
            else:
                # equal ranks: the same token twice; the left one was merged first
                limit, b = rank[b] + 1, left[b]

    def merge(self, text: str) -> list[int]:
        """Token ids of one word of atoms."""
        whole = self.by_atoms.get(text)
        if whole is not None:
            return [whole]
        known, fits = self._fits, self.fits
        # The path of longest matches alone; most words need no step back.
        out = [i for _, i in self.trie.iter_long(text)]
        for pair in zip(out, out[1:]):
            if not (known[pair] if pair in known else fits(*pair)):
                return self._backtrack(text)
        return out

    def _longest(self, text: str, at: int) -> int:
        get = self.by_atoms.get
        for end in range(min(len(text), at + self.longest), at, -1):
            i = get(text[at:end])
            if i is not None:
                return i
        raise AssertionError("every atom is a token")

    def _backtrack(self, text: str) -> list[int]:
        size, shorter, known, fits, n = self.size, self.shorter, self._fits, self.fits, len(text)
        dead = bytearray(n + 1)
        out: list[int] = []
        last = -1
        at, token = 0, self._longest(text, 0)
        while True:
            end = at + size[token]
            if not dead[end] and (last < 0 or (known[last, token] if (last, token) in known else fits(last, token))):
                out.append(token)
                if end == n:
                    return out
                last, at = token, end
                token = self._longest(text, at)
                continue
            token = shorter.get(token)
            while token is None:
                dead[at] = 1
                token = out.pop()
                last = out[-1] if out else -1
                at -= size[token]
                token = shorter.get(token)

    def _piece(self, piece: bytes) -> bytes:
        data = piece.decode("latin-1")
        return array("I", self.merge(data[:-1] + chr(ord(data[-1]) + 256))).tobytes()

    @staticmethod
    def normal(text: str) -> str:
        if text.isascii():
            return text.lower()
        # Only capital sigma has a lower case that depends on its place.
        return unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower()

    def pieces(self, text: str) -> list[str]:
        """The words of a text without special tokens."""
        if self.odd is not None and not text.isascii() and self.odd[np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")].any():
            library = self._library()
            plain = library.normalizer.normalize_str(text)
            return [bytes(self.byte_of[c] for c in piece).decode() for piece, _ in library.pre_tokenizer.pre_tokenize_str(plain)]
        return self.pattern.findall(self.normal(text))

    def _library(self):
        if self._theirs is None:
            self._theirs = library_of(self.path)
        return self._theirs

    def encode_plain(self, text: str) -> bytes:
        """Ids of a text without special tokens, packed as little-endian 32-bit numbers."""
        cache, out = self._word, []
        for piece in self.pieces(text):
            got = cache.get(piece)
            if got is None:
                got = self._older.get(piece)
                if got is None:
                    got = self._piece(piece.encode())
                if len(piece) < 64:
                    if len(cache) >= CACHE_WORDS:
                        self._older, self._word = cache, {}
                        cache = self._word
                    cache[piece] = got
            out.append(got)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        if not any(t in text for t in self.special):
            return self.encode_plain(text)
        return b"".join(self.special[p].to_bytes(4, "little") if p in self.special else self.encode_plain(p) for p in self.split_special.split(text))

    def decode(self, ids: bytes) -> bytes:
        """Token strings joined by blanks, gathered from the offset table in blocks."""
        numbers = np.frombuffer(ids, "<u4")
        out = []
        for k in range(0, len(numbers), 1 << 16):
            part = numbers[k : k + (1 << 16)]
            start = self.offsets[part]
            size = self.offsets[part + 1] - start
            ends = np.cumsum(size)
            out.append(self.table[np.repeat(start - ends + size, size) + np.arange(ends[-1])].tobytes())
        return b"".join(out)[:-1]


_LOADED: dict[str, Tokenizer] = {}


def tokenizer(path: str, odd: bytes | None = None) -> Tokenizer:
    """The tokenizer of a file, loaded once a process; ``odd`` is what ``odd_characters`` says."""
    if path not in _LOADED:
        _LOADED[path] = Tokenizer(path)
    out = _LOADED[path]
    if odd is not None and out.odd is None:
        out.odd = np.unpackbits(np.frombuffer(odd, "u1")).astype(bool)
    return out


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode(documents: DataFrame, path: str | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, token_ids (packed little-endian 32-bit) and decoded (text) of every document."""
    path = path or default_vocabulary()
    df = documents.select(*keep, raw().alias("__raw"))
    schema = df.select(*keep).schema.add("token_ids", "binary").add("decoded", "binary")
    odd = documents.sparkSession.sparkContext.broadcast(odd_characters(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = tokenizer(path, odd.value)
        for batch in chunks(batches, "__raw"):
            ids = [model.encode(t.decode("utf-8", "replace")) for t in batch.column("__raw").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(ids, pa.binary()), pa.array(map(model.decode, ids), pa.binary())], [*keep, "token_ids", "decoded"])

    return map_arrow(df, run, schema)


def encode_digests(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and the decoded text that ``encode`` returns."""
    return digests(encode(documents, path)).drop("token_ids", "decoded")


def digests(encoded: DataFrame) -> DataFrame:
    """``encoded`` with n_tokens, ids_sha256 and decoded_sha256 of its token_ids and decoded."""
    return encoded.withColumns({"n_tokens": F.floor(F.length("token_ids") / 4), "ids_sha256": F.sha2("token_ids", 256), "decoded_sha256": F.sha2("decoded", 256)})
