"""BPE encoding and decoding (operator 9).

Encoder. The vocabulary is a trie; an Aho-Corasick automaton gives the longest token that starts
at a place. Tokens are taken greedily and one is kept only if the pair (previous, new) is what the
merges themselves would leave side by side; otherwise the next shorter token, or else the previous
token is given up and its end marked as a dead end. Every place is marked at most once, so the
work is linear in the length. The result equals applying all merges in order of rank.

A pair (a, b) is compatible if undoing the merges of a and b, the later one first, never meets a
pair across the border that has a merge of lower rank. Answers are kept in a table.

Decoder. All token texts lie in one byte array; ``offsets[id] : offsets[id + 1]`` is the text of a
token, and the texts of a whole list of ids are gathered at once.

Defined cases. A null text counts as the empty text and has no tokens; the decoded text of no
tokens is empty. Rows with equal or null ids are encoded one by one. An empty table gives an empty
result. Other columns, whatever their names, are not touched: ``with_tokens`` adds one struct
column under the name asked for and replaces a column of that name.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Callable
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm.common import in_slices, map_slices, small_batches

#: Fixed values of the public word-level BPE format: its white space, its pattern, its end mark.
WHITE = r"\t-\r \x85\xa0  -     　"
PIECE = rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{WHITE}\p{{L}}\p{{N}}]+"

#: The last symbol of a word is another symbol than the same byte inside it.
_END = 0x10000

#: Pieces whose tokens a worker remembers; beyond, it begins anew with the next text.
REMEMBERED = 250_000
#: Pairs of tokens whose compatibility is remembered.
PAIRS = 400_000


def byte_alphabet() -> list[str]:
    """The visible character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(hidden)) for b in range(256)]


class Memo(dict):
    """Answers of a function by its argument; those to long arguments aren't kept."""

    def __init__(self, fn: Callable[[str], tuple[int, ...]]) -> None:
        super().__init__()
        self.fn = fn

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.fn(piece)
        if len(piece) < 64:
            self[piece] = ids
        return ids


class WordBpe:
    """A word-level BPE vocabulary with an end mark, read from a public tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix: str = model["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = special
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.piece = regex.compile(PIECE)
        self.alphabet = byte_alphabet()
        self.plain = str.maketrans({chr(b): c for b, c in enumerate(self.alphabet)})
        self.bytes_of = {c: b for b, c in enumerate(self.alphabet)}
        # Normalisation and, for characters newer than Python's tables, the cut into words are a
        # matter of Unicode versions and follow the library; the merges are made here.
        rules = Tokenizer.from_file(path)
        self.normalizer, self.cutter = rules.normalizer, rules.pre_tokenizer
        self.aged: dict[str, bool] = {}

        self._merges(model["merges"], vocab)
        self._trie(vocab)
        names = vocab | special
        size = max(names.values()) + 1
        shown = [b""] * size
        for text, i in names.items():
            shown[i] = text.encode() + b" "
        self.offsets = np.concatenate([[0], np.cumsum([len(b) for b in shown])]).astype(np.int64)
        self.texts = np.frombuffer(b"".join(shown), np.uint8)
        self.memo = Memo(self.of_piece)
        #: Every id in decimal.
        self.digits = [str(i) for i in range(size)]

    def _merges(self, merges: list, vocab: dict[str, int]) -> None:
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in merges]
        self.merged: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        for rank, (a, b) in enumerate(pairs):
            whole = vocab[a + b]
            if whole in self.halves:
                raise ValueError(f"two merges make the token {a + b!r}; ranks of tokens are then not defined")
            self.merged[vocab[a], vocab[b]] = whole
            self.halves[whole] = vocab[a], vocab[b]
            self.rank[whole] = rank
        self._fits: dict[int, bool] = {}

    def _trie(self, vocab: dict[str, int]) -> None:
        usable = {}
        for text, i in vocab.items():
            if i not in self.halves or self._survives(*self.halves[i], self.rank[i]):
                usable[self._symbols(text)] = i
        self.longest = ahocorasick.Automaton()
        self.length: dict[int, int] = {}
        self.shorter: dict[int, int] = {}
        for s, i in usable.items():
            self.longest.add_word(s, i)
            self.length[i] = len(s)
            self.shorter[i] = next((usable[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in usable), -1)
        self.longest.make_automaton()

    def _symbols(self, text: str) -> str:
        if not text.endswith(self.suffix):
            return text
        body = text[: -len(self.suffix)]
        return body[:-1] + chr(ord(body[-1]) + _END) if body else text

    def _survives(self, a: int, b: int, limit: float = float("inf")) -> bool:
        """Whether the merges of rank below ``limit`` leave a and b next to each other."""
        rank, halves = self.rank, self.halves
        while True:
            whole = self.merged.get((a, b))
            if whole is not None and rank[whole] < limit:
                return False
            ra, rb = rank.get(a, -1), rank.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            # The later of the two merges is undone. Up to its rank the border must hold; an equal
            # rank on the right may still come first, because merges go from left to right.
            if ra > rb:
                limit, a = ra, halves[a][1]
            else:
                limit, b = rb + 1, halves[b][0]

    def compatible(self, a: int, b: int) -> bool:
        pair = a << 32 | b
        known = self._fits.get(pair)
        if known is None:
            if len(self._fits) >= PAIRS:
                self._fits.clear()
            known = self._fits[pair] = self._survives(a, b)
        return known

    def encode_word(self, s: str) -> list[int]:
        """Tokens of one word, given as symbols."""
        end, longest, length, shorter, fits = len(s), self.longest, self.length, self.shorter, self._fits
        alive = bytearray(b"\1") * (end + 1)
        out: list[int] = []
        at, token = 0, next(longest.iter_long(s))[1]
        while at < end:
            last = out[-1] if out else -1
            while token >= 0:
                to = at + length[token]
                if alive[to]:
                    if last < 0:
                        break
                    known = fits.get(last << 32 | token)
                    if known or known is None and self.compatible(last, token):
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at = to
                if at < end:
                    token = next(longest.iter_long(s, at))[1]
            else:
                alive[at] = 0
                token = shorter[out.pop()]
                at -= length[last]
        return out

    def pieces(self, text: str) -> list[str]:
        """The words of a text without special tokens, after normalisation."""
        if text.isascii():
            return self.piece.findall(text.lower())
        text = self.normalizer.normalize_str(text)
        if all(map(self._known, set(text))):
            return self.piece.findall(text)
        return [bytes(map(self.bytes_of.__getitem__, shown)).decode() for shown, _ in self.cutter.pre_tokenize_str(text)]

    def _known(self, c: str) -> bool:
        if c not in self.aged:
            self.aged[c] = unicodedata.category(c) != "Cn"
        return self.aged[c]

    def of_piece(self, piece: str) -> tuple[int, ...]:
        s = piece.translate(self.plain) if piece.isascii() else "".join([self.alphabet[b] for b in piece.encode()])
        return tuple(self.encode_word(s[:-1] + chr(ord(s[-1]) + _END)))

    def encode(self, text: str) -> list[int]:
        memo = self.memo
        if len(memo) > REMEMBERED:
            memo.clear()
        if "<" not in text or self.split_special is None:
            return list(chain.from_iterable(map(memo.__getitem__, self.pieces(text))))
        out: list[int] = []
        for k, part in enumerate(self.split_special.split(text)):
            out += [self.special[part]] if k % 2 else chain.from_iterable(map(memo.__getitem__, self.pieces(part)))
        return out

    def decode(self, ids: list[int] | np.ndarray) -> str:
        """The token texts, joined by blanks (the format names no decoder)."""
        ids = np.asarray(ids, np.int64)
        if not len(ids):
            return ""
        begin = self.offsets[ids]
        size = self.offsets[ids + 1] - begin
        ends = np.cumsum(size)
        at = np.repeat(begin - (ends - size), size) + np.arange(ends[-1])
        return self.texts[at].tobytes()[:-1].decode()


_LOADED: dict[str, WordBpe] = {}


def load(path: str) -> WordBpe:
    """The vocabulary at a path, read once per worker."""
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, its token ids and the text decoded from them."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = load(path)
        ids = [bpe.encode(t or "") for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([bpe.decode(x) for x in ids], pa.string())], ["id", "ids", "decoded"])

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_slices(src, 1, run, f"id {dict(src.dtypes)['id']}, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def token_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: number of tokens and the SHA-256 of the ids and of the decoded text.

    The digests are taken where the tokens are made, so that neither list leaves the worker.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = load(path)
        n, a, b = [], [], []
        for t in batch.column(1).to_pylist():
            ids = bpe.encode(t or "")
            n.append(len(ids))
            a.append(hashlib.sha256(" ".join(map(bpe.digits.__getitem__, ids)).encode()).hexdigest())
            b.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(src.dtypes)["id"]
    return map_slices(src, 1, run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)


def with_tokens(docs: DataFrame, path: str, text_col: str = "text", out_col: str = "tokens") -> DataFrame:
    """All rows and columns, with a struct column of token ids and their number."""

    @F.arrow_udf("struct<ids: array<int>, n: int>")
    def tokens(text: pa.Array) -> pa.Array:
        return in_slices(text, of)

    def of(text: pa.Array) -> pa.Array:
        bpe = load(path)
        ids = [bpe.encode(t or "") for t in text.to_pylist()]
        return pa.StructArray.from_arrays([pa.array(ids, pa.list_(pa.int32())), pa.array([len(x) for x in ids], pa.int32())], ["ids", "n"])

    small_batches(docs.sparkSession)
    return docs.withColumn(out_col, tokens(F.col(text_col).cast("string")))
