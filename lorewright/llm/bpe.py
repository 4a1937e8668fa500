"""BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a word the table holds the last token of the prefix's encoding. That token is
unique: of the tokens that end there (an Aho-Corasick automaton over the vocabulary gives all suffix
matches), exactly one fits the last token of the prefix before it. Two tokens fit if merging their
joint symbols would never merge across the boundary. Back-pointers then give the exact ids.

The words of a text are independent, so each worker keeps the encodings of recent words, and those of the
runs of letters that rare words with signs around them are made of.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, IntegerType

from .common import read

#: Added to the last character of a word: a symbol that ends a word is another symbol.
ENDS = 1024
WORD_END = "</w>"
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
ODD_SPACE = re.compile("[\x1c-\x1f]")
#: Words kept by a worker before the older ones go.
KEPT_WORDS = 80_000
#: Answers about pairs of tokens kept by a worker before all go.
KEPT_PAIRS = 500_000


def byte_letters() -> list[str]:
    """The printable letter for each byte: itself if printable in Latin-1, else the next letter from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(free)) for b in range(256)]


class Recent(dict):
    """What `make` gives for a key, kept for the last keys that were asked for: up to two times KEPT_WORDS."""

    def __init__(self, make: Callable):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key):
        if len(self) >= KEPT_WORDS:
            self.old = dict(self)
            self.clear()
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        self[key] = found
        return found


class Encoder:
    """Encodes as the tokenizer whose JSON text is given."""

    def __init__(self, spec: str):
        j = json.loads(spec)
        model = j["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.specials = {t["content"]: t["id"] for t in j["added_tokens"] if t["special"]}
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.specials.items()}
        self.split_specials = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")") if self.specials else None
        self.letters = dict(enumerate(byte_letters()))
        self.rank: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merge: dict[tuple[int, int], int] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y, t = self.vocab[a], self.vocab[b], self.vocab[a.removesuffix(WORD_END) + b if a.endswith(WORD_END) else a + b]
            self.merge.setdefault((x, y), r)
            if t not in self.parts:
                self.parts[t], self.rank[t] = (x, y), r
        self.fits_after: dict[int, dict[int, bool]] = {}
        self.n_kept = 0
        self.shown = {t: str(t) for t in self.tokens}
        self.words = Recent(self._word)
        self.pieces = Recent(self.encode_piece)
        self.ends: dict[int, list[tuple[int, float, float]]] = {}
        self.starts: dict[int, list[tuple[int, float, float]]] = {}
        self.automaton = ahocorasick.Automaton()
        for t, i in self.vocab.items():
            if self._whole(i):
                s = t[: -len(WORD_END)] if t.endswith(WORD_END) and t != WORD_END else t
                self.automaton.add_word(s if s is t else s[:-1] + chr(ord(s[-1]) + ENDS), (i, len(s)))
        self.automaton.make_automaton()

    def _spine(self, t: int, side: int) -> list[tuple[int, float, float]]:
        """The tokens at one end of t over time: (token, rank that made it, rank that merges it into the next)."""
        memo = self.starts if side == 0 else self.ends
        if t not in memo:
            out, x, until = [], t, float("inf")
            while True:
                born = self.rank.get(x, -1)
                out.append((x, born, until))
                if x not in self.parts:
                    break
                x, until = self.parts[x][side], born
            memo[t] = out
        return memo[t]

    def _first_across(self, a: int, b: int) -> float:
        """The least rank of a merge across the boundary of a and b while both are built."""
        best = float("inf")
        for x, born_x, until_x in self._spine(a, 1):
            for y, born_y, until_y in self._spine(b, 0):
                r = self.merge.get((x, y))
                # of equal ranks the left one comes first: before it inside a, after it inside b
                if r is not None and born_x < r and born_y < r and r < until_x and r <= until_y:
                    best = min(best, r)
        return best

    def _whole(self, t: int) -> bool:
        """Whether the symbols of t merge into t."""
        while t in self.parts:
            a, b = self.parts[t]
            if self._first_across(a, b) != self.rank[t] or not self._whole(b):
                return False
            t = a
        return True

    def fits(self, a: int, b: int) -> bool:
        """Whether b may follow a. The answers are kept by a, up to KEPT_PAIRS of them."""
        row = self.fits_after.setdefault(a, {})
        known = row.get(b)
        if known is None:
            self.n_kept += 1
            if self.n_kept > KEPT_PAIRS:
                self.n_kept = 1
                self.fits_after.clear()
                row = self.fits_after.setdefault(a, {})
            known = row[b] = self._first_across(a, b) == float("inf")
        return known

    def encode_piece(self, piece: str) -> list[int]:
        s = piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.letters)
        s = s[:-1] + chr(ord(s[-1]) + ENDS)
        last, length, rows = [-1] * len(s), [0] * len(s), [None] * len(s)
        after, fits = self.fits_after, self.fits
        for end, (token, n) in self.automaton.iter(s):
            if length[end]:
                continue
            if n <= end:
                row = rows[end - n]
                ok = None if row is None else row.get(token)
                if ok is None:
                    ok = fits(last[end - n], token)
                    rows[end - n] = after[last[end - n]]
                if not ok:
                    continue
            last[end], length[end] = token, n
            rows[end] = after.get(token)
        ids, at = [], len(s) - 1
        while at >= 0:
            ids.append(last[at])
            at -= length[at]
        ids.reverse()
        return ids

    def _word(self, word: str) -> tuple[str, str]:
        """Ids and tokens of a word without white space, each joined by spaces."""
        if word.isalpha() and word.isascii():
            return self._entry(self.encode_piece(word))
        pieces = PIECE.findall(word)
        return self._entry(self.encode_piece(word) if len(pieces) == 1 else [i for p in pieces for i in self.pieces[p]])

    def _entry(self, ids: list[int]) -> tuple[str, str]:
        return " ".join(map(self.shown.__getitem__, ids)), " ".join(map(self.tokens.__getitem__, ids))

    def text(self, text: str) -> list[tuple[str, str]]:
        """The entries of the words of a text; joined they are its encoding."""
        out = []
        segments = self.split_specials.split(text) if self.split_specials and "<|" in text else [text]
        for s in segments:
            if s in self.specials:
                out.append(self._entry([self.specials[s]]))
                continue
            if not s.isascii():
                # lower-casing goes character by character: no final sigma
                s = unicodedata.normalize("NFC", s).replace("Σ", "σ")
            s = s.lower()
            words = filter(None, regex.split(r"\p{White_Space}+", s)) if ODD_SPACE.search(s) else s.split()
            out += map(self.words.__getitem__, words)
        return out

    def decode(self, ids: list[int]) -> str:
        """The tokens joined by one space, as the tokenizer has no decoder."""
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)


_ENCODERS: dict[str, Encoder] = {}


def encoder(spec: str) -> Encoder:
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(spec)
    return _ENCODERS[key]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ids: bool = True) -> DataFrame:
    """keep columns, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids as array<int>.

    Null text counts as empty: no tokens, the hash of nothing. Equal rows give equal rows; texts may be of any
    length. An empty table gives an empty result. Columns of docs other than text and keep are not read; keep may not
    name one of the new columns. The vocabulary file (some MB) is read once and broadcast.
    """
    spark = docs.sparkSession
    with open(path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    source = docs.select(*keep, text)
    schema = source.drop(text).schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    if ids:
        schema = schema.add("ids", ArrayType(IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(spec.value)
        for whole in batches:
            for b in (whole.slice(k, 256) for k in range(0, whole.num_rows, 256)):
                n, id_hash, text_hash, packed = [], [], [], []
                for t in b.column(len(keep)):
                    entries = e.text(t.as_py() or "")
                    written = " ".join([x[0] for x in entries])
                    n.append(written.count(" ") + 1 if written else 0)
                    id_hash.append(hashlib.sha256(written.encode()).hexdigest())
                    text_hash.append(hashlib.sha256(" ".join([x[1] for x in entries]).encode()).hexdigest())
                    if ids:
                        packed.append(np.array(written.split(), np.int32))
                columns = [*b.columns[: len(keep)], pa.array(n, pa.int64()), pa.array(id_hash, pa.string()), pa.array(text_hash, pa.string())]
                if ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(np.concatenate(packed))))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return source.mapInArrow(run, schema)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(read(spark, sf_dir, "documents"), default_path(), ids=False)
