"""Quality rules with n-gram perplexity bands per language (operator 2).

Base rules count words, symbols, repeated lines and repeated windows of three words. What passes
them is judged by the perplexity of its words in their order, and of its spelling.

Words. Pairs of words (A to Z lower-cased; begin and end of the text count) in the interpolated modified
Kneser-Ney model of ``lm``, over all texts; words of different languages have nothing in common. A text is
scored by what the other texts have: its own counts are taken off, so that its order is not compared with
itself. A pair that occurs once has no such count and is counted, but not written.

Spelling. A character n-gram model per language (order ``ORDER``, words with a begin and an end mark),
interpolated modified Kneser-Ney, counted in Spark over all texts that pass the base rules. The estimate is
a few aggregations and joins of n-grams; the model lies in the shared folder as sorted hash arrays that
workers memory-map.

Bands. Per language and model, the centre is the median of the logarithm of the perplexity over all passing
documents and the unit is the median distance from it below and above (times 1.4826); documents
more than ``BAND`` units below or above are rejected, by words only above: what other texts repeat is
low there, and near copies are another operator's. Both come from Spark's quantile sketch, one
row per language. The unit is at least ``LEAST_UNIT``, so that a language of few or equal documents
rejects none for tiny differences.

Defined cases. A null text has no words and fails the base rules; so does an empty one. A null
language is a language of its own. Rows are judged one by one, whatever their ids. A language whose
documents all fail the base rules has no model; its documents are rejected by these. An empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain, count, islice, pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import lm
from tessera.llm.common import forget, map_batches, scratch, shuffles_freed, small_batches, stored
from tessera.llm.hashstore import Opened, Shards, shard_of, write_arrays

ORDER = 4
BAND = 5.0
LEAST_UNIT = 0.004
MIN_WORDS = 50
#: N-grams per shard of the model, about, and the fewest and most bits of a shard's number.
SHARD_GRAMS, MIN_BITS, MAX_BITS = 1 << 20, 4, 16
#: No word has white space, so these stand for the begin and the end of one.
BEGIN, END = "\n", " "
_PAD = BEGIN * (ORDER - 1)
#: Rows of languages that are broadcast at most.
BROADCAST_ROWS = 100_000
SYMBOLS = "#*$%&|<>"
#: Characters of text that are looked at together.
SLICE_CHARS = 1 << 21
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def words_of(text: str | None) -> list[bytes]:
    """Words in UTF-8; bytes are split at blanks and the control characters 9 to 13."""
    return (text or "").encode().split()


#: Distinct words that a worker keeps numbers (and counts or scores) for.
HELD_WORDS = 300_000


class Numbers:
    """Numbers for words, in the order in which they are first met."""

    def __init__(self) -> None:
        self.number: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.own: list[bytes] = []

    def of(self, lists: list[list[bytes]]) -> list[np.ndarray]:
        """The numbers of the words of each text."""
        begins = np.cumsum([0, *map(len, lists)])
        ids = np.fromiter(map(self.number.__getitem__, chain.from_iterable(lists)), np.int64, int(begins[-1]))
        self.own += islice(self.number, len(self.own), None)
        return [ids[a:z] for a, z in pairwise(begins.tolist())]

    @property
    def full(self) -> bool:
        return len(self.own) > HELD_WORDS


def base_features(text: str | None, ids: np.ndarray | None = None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text; ``ids`` are its words' numbers."""
    t = text or ""
    if ids is None:
        ids = Numbers().of([words_of(t)])[0]
    seen: set[str] = set()
    dup = 0
    for line in t.split("\n"):
        if line in seen:
            dup += 1
        elif line.strip(" \t\n\v\f\r"):
            seen.add(line)
    blanks = sum(map(t.count, " \t\n\v\f\r"))
    return len(ids), len(t) - blanks, sum(map(t.count, SYMBOLS)), dup, repeated_words(ids)


def repeated_words(ids: np.ndarray) -> int:
    """Words in windows of three that occur twice or more."""
    if len(ids) < 4:
        return 0
    n = int(ids.max()) + 1
    pairs = ids[:-1] * n + ids[1:]
    if n >= 1 << 20:
        pairs = np.unique(pairs, return_inverse=True)[1]
    triples = pairs[:-1] * n + ids[2:]
    once = np.sort(triples)
    if not (once[1:] == once[:-1]).any():
        return 0
    order = np.argsort(triples)
    same = triples[order[1:]] == triples[order[:-1]]
    inside = np.zeros(len(ids), bool)
    for who in (order[1:][same], order[:-1][same]):
        for k in range(3):
            inside[who + k] = True
    return int(inside.sum())


def slices(*columns: pa.Array) -> Iterator[tuple[slice, list[list]]]:
    """Rows of a few megabytes of text at a time; the texts are the last column."""
    rows = [c.to_pylist() for c in columns]
    at, held = 0, 0
    for i, t in enumerate(rows[-1]):
        held += len(t or "")
        if held >= SLICE_CHARS or i + 1 == len(rows[-1]):
            yield slice(at, i + 1), [r[at : i + 1] for r in rows]
            at, held = i + 1, 0


def passes(n_words: int, n_repeat_words: int) -> bool:
    return n_words >= MIN_WORDS and 100 * n_repeat_words <= 50 * n_words


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def endings(words: list[bytes]) -> tuple[list[np.ndarray], np.ndarray, bool]:
    """Of every letter of the words and of every end of a word: the letter and the ``ORDER`` - 1 before it, the last
    first, as code points (``BEGIN`` as often as there is none); one number for these that differs if they do, and
    whether it is the same in every call."""
    line = _PAD + (END + _PAD).encode().join(words).decode() + END
    codes = np.frombuffer(line.encode("utf-32-le"), np.uint32)
    at = np.flatnonzero(codes != ord(BEGIN))
    columns = [codes[at - k] for k in range(ORDER)]
    if int(codes.max()) < 1 << 64 // ORDER:
        numbers = columns[0].astype(np.uint64)
        for k in range(1, ORDER):
            numbers |= columns[k].astype(np.uint64) << np.uint64(64 // ORDER * k)
        return columns, numbers, True
    letters, dense = np.unique(codes, return_inverse=True)
    return columns, packed([dense[at - k] for k in range(ORDER)], len(letters)), False


def distinct(columns: list[np.ndarray], numbers: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The distinct rows of ``endings`` in the order of their numbers, these, and which of them each row is."""
    own, back = np.unique(numbers, return_inverse=True)
    some = np.empty(len(own), np.int64)
    some[back] = np.arange(len(back))
    return [c[some] for c in columns], own, back


def gram_hashes(letters: list[np.ndarray], language: int) -> np.ndarray:
    """Hashes of n-grams given as n columns of code points, the first letters first."""
    with np.errstate(over="ignore"):
        h = np.full(len(letters[0]) if letters else 1, language, np.uint64) + np.uint64(len(letters)) * _FACTORS[4]
        for k, x in enumerate(reversed(letters)):
            h = h + mixed(x.astype(np.uint64) * _FACTORS[k] + np.uint64(k + 1))
        return mixed(h)


def language_hash(lang: str | None) -> int:
    return xxhash.xxh64_intdigest((lang or "").encode(), 1 if lang is None else 0)


def letters_key(lang: str | None) -> int:
    """Under which the number of letters of a language is kept."""
    return xxhash.xxh64_intdigest((lang or "").encode(), 3 if lang is None else 2)


def counted(words: dict[str, int]) -> tuple[list[str], np.ndarray]:
    """The longest n-gram at every letter of the words (up to ``ORDER``), and how often it occurs."""
    return counted_bytes([w.encode() for w in words], np.fromiter(words.values(), np.int64, len(words)))


def counted_bytes(words: list[bytes], n: np.ndarray) -> tuple[list[str], np.ndarray]:
    """``counted`` of words in UTF-8 and their counts."""
    every, numbers, _ = endings(words)
    columns, _, back = distinct(every, numbers)
    ends = np.flatnonzero(every[0] == ord(END))
    c = np.bincount(back, np.repeat(n, np.diff(ends, prepend=-1))).astype(np.int64)
    line = np.stack(columns[::-1], axis=1).astype("<u4").tobytes().decode("utf-32-le")
    rows = [line[i : i + ORDER] for i in range(0, len(line), ORDER)]
    return [BEGIN + g.lstrip(BEGIN) if g[0] == BEGIN else g for g in rows], c


def packed(columns: list[np.ndarray], n: int) -> np.ndarray:
    """One number per row of numbers below n; rows are equal if and only if their numbers are."""
    out, size = columns[0].astype(np.uint64), n
    for c in columns[1:]:
        if size * n >= 1 << 64:
            out = np.unique(out, return_inverse=True)[1].astype(np.uint64)
            size = int(out.max()) + 1 if len(out) else 1
        out, size = out * np.uint64(n) + c.astype(np.uint64), size * n
    return out


def count_grams(docs: DataFrame) -> DataFrame:
    """``lang``, ``gram``, ``c`` over the texts that pass the base rules."""

    def emit(numbers: Numbers, counts: dict[str | None, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for lang, n in counts.items():
            used = np.flatnonzero(n).tolist()
            for i in range(0, len(used), 1 << 17):
                part = used[i : i + (1 << 17)]
                grams, c = counted_bytes([numbers.own[k] for k in part], n[part])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams, pa.string()), pa.array(c)], ["lang", "gram", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, counts = Numbers(), {}
        for batch in batches:
            for _, (langs, texts) in slices(*batch.columns):
                parts = numbers.of([words_of(t) for t in texts])
                good = [i for i, ids in enumerate(parts) if passes(len(ids), repeated_words(ids))]
                for lang in {langs[i] for i in good}:
                    n = np.bincount(np.concatenate([parts[i] for i in good if langs[i] == lang]), minlength=len(numbers.own))
                    if lang in counts:
                        n[: len(counts[lang])] += counts[lang]
                    counts[lang] = n
                if numbers.full or len(counts) > 64:
                    yield from emit(numbers, counts)
                    numbers, counts = Numbers(), {}
        yield from emit(numbers, counts)

    small_batches(docs.sparkSession)
    return docs.select("lang", "text").mapInArrow(run, "lang string, gram string, c long").groupBy("lang", "gram").agg(F.sum("c").alias("c"))


def estimate(grams: DataFrame) -> DataFrame:
    """``lang``, ``gram``, ``share``, ``left``: the discounted share of every n-gram, and what its
    context leaves to the next lower order. The shortest n-grams have one letter."""
    size = F.length("gram")
    begins = F.col("gram").startswith(BEGIN)
    level = grams.where(size == ORDER).select("lang", "gram", "c")
    levels = [level]
    for n in range(ORDER - 1, 0, -1):
        # N-grams that begin a word have nothing before them and keep their count; for others the
        # number of different letters before them takes its place.
        tails = level.select("lang", F.substring("gram", 2, n).alias("gram")).groupBy("lang", "gram").agg(F.count(F.lit(1)).alias("c"))
        firsts = grams.where((size == n) & begins).select("lang", "gram", "c")
        level = stored(tails.unionByName(firsts).groupBy("lang", "gram").agg(F.sum("c").alias("c")), "grams")
        levels.append(level)
    every = levels[0]
    for x in levels[1:]:
        every = every.unionByName(x)
    every = every.withColumn("n", F.length("gram"))
    times = lambda k: F.sum((F.col("c") == k).cast("double"))
    spread = every.groupBy("lang", "n").agg(*[times(k).alias(f"n{k}") for k in (1, 2, 3, 4)])
    y = F.col("n1") / F.greatest(F.col("n1") + 2 * F.col("n2"), F.lit(1.0))
    raw = [k - (k + 1) * y * F.col(f"n{k + 1}") / F.greatest(F.col(f"n{k}"), F.lit(1.0)) for k in (1, 2, 3)]
    d = [F.when((F.col(f"n{k}") > 0) & (x > 0) & (x < k), x).otherwise(k / 2) for k, x in enumerate(raw, 1)]
    spread = spread.select(F.col("lang").alias("sl"), F.col("n").alias("sn"), *[x.alias(f"d{k}") for k, x in enumerate(d, 1)])
    every = every.join(spread, F.col("lang").eqNullSafe(F.col("sl")) & (F.col("n") == F.col("sn")))
    off = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
    every = every.select("lang", "gram", "n", "c", F.least(off, F.col("c").cast("double")).alias("off"), F.expr("substring(gram, 1, n - 1)").alias("context"))
    of = every.groupBy(F.col("lang").alias("cl"), F.col("n").alias("cn"), F.col("context").alias("cc")).agg(F.sum("c").alias("total"), F.sum("off").alias("spare"))
    joined = every.join(of, F.col("lang").eqNullSafe(F.col("cl")) & (F.col("n") == F.col("cn")) & (F.col("context") == F.col("cc")))
    return joined.select("lang", "gram", ((F.col("c") - F.col("off")) / F.col("total")).alias("share"), (F.col("spare") / F.col("total")).alias("left"))


@dataclass
class Spelling:
    """The model in the shared folder: shares by n-gram (and the number of letters by language), leftovers
    by context (with its order)."""

    shares: Shards
    left: Shards


def write_model(docs: DataFrame) -> Spelling:
    """Counts, estimates and writes the model of all texts of ``docs`` (``lang``, ``text``)."""
    spark = docs.sparkSession
    counts = stored(count_grams(docs), "counts")
    model = stored(estimate(counts), "model")
    forget(counts)
    bits = min(MAX_BITS, max(MIN_BITS, math.ceil(math.log2(max(1, model.count() / SHARD_GRAMS)))))
    folder, parts = scratch(spark, "spelling"), 1 << bits

    def hashed(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        langs = batch.column(0).to_pylist()
        keys = np.fromiter(map(language_hash, langs), np.uint64, len(langs))
        grams = batch.column(1).to_pylist()
        size = np.fromiter(map(len, grams), np.int64, len(grams))
        own, ctx = np.zeros(len(grams), np.uint64), np.zeros(len(grams), np.uint64)
        for key in np.unique(keys):
            for n in range(1, ORDER + 1):
                at = np.flatnonzero((keys == key) & (size == n))
                if not len(at):
                    continue
                m = np.frombuffer("".join([grams[i] for i in at.tolist()]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, n)
                own[at] = gram_hashes(list(m.T), int(key))
                ctx[at] = gram_hashes([*m.T[:-1]], int(key)) if n > 1 else gram_hashes([], int(key))
        for kind, h, v in ((0, own, batch.column(2)), (1, ctx, batch.column(3))):
            yield pa.RecordBatch.from_arrays([pa.array(shard_of(h, bits, False) + kind * parts), pa.array(h.view(np.int64)), v], ["shard", "key", "value"])

    def letters_of(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        h = np.array([letters_key(x) for x in batch.column(0).to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(shard_of(h, bits, False)), pa.array(h.view(np.int64)), batch.column(1)], ["shard", "key", "value"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            s = batch.column(0).to_numpy()
            for x in np.unique(s).tolist():
                held.setdefault(x, []).append((batch.column(1).to_numpy()[s == x], batch.column(2).to_numpy()[s == x]))
        for x, rows in held.items():
            keys, first = np.unique(np.concatenate([k for k, _ in rows]).view(np.uint64), return_index=True)
            write_arrays(f"{folder}/{x // parts}/{x % parts:06d}", keys, np.concatenate([v for _, v in rows])[first])
            yield pa.RecordBatch.from_pylist([{"shard": x, "size": len(keys)}])

    schema = "shard long, key long, value double"
    letters = model.where(F.length("gram") == 1).groupBy("lang").agg(F.count(F.lit(1)).cast("double").alias("n"))
    flat = map_batches(model.select("lang", "gram", "share", "left"), hashed, schema).dropDuplicates(["shard", "key"]).union(map_batches(letters, letters_of, schema))
    sizes = [[0] * parts, [0] * parts]
    for r in flat.repartition(2 * parts, "shard").mapInArrow(write, "shard long, size long").collect():  # a row per shard
        sizes[r["shard"] // parts][r["shard"] % parts] = r["size"]
    forget(model)
    return Spelling(*[Shards(f"{folder}/{k}", bits, False, sizes[k], ["<f8"]) for k in (0, 1)])


#: N-grams whose scores a worker keeps.
HELD_GRAMS = 1 << 18


class Speller:
    """The mapped model in a worker."""

    def __init__(self, model: Spelling) -> None:
        self.m, self.shares, self.left = model, model.shares.open(), model.left.open()
        #: By language: the numbers of the n-grams met before, in order, and their scores.
        self.known: dict[str | None, tuple[np.ndarray, np.ndarray]] = {}

    def word_scores(self, words: list[bytes], lang: str | None) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability of each word with its end, and its number of letters with the end."""
        every, numbers, lasting = endings(words)
        columns, own, back = distinct(every, numbers)
        logs = self.kept_logs(columns, own, lang) if lasting else self.letter_logs(columns, lang)
        ends = np.flatnonzero(every[0] == ord(END))
        sizes = np.diff(ends, prepend=-1)
        return np.add.reduceat(logs[back], ends + 1 - sizes), sizes

    def kept_logs(self, columns: list[np.ndarray], own: np.ndarray, lang: str | None) -> np.ndarray:
        """``letter_logs``, which asks the model only for n-grams not met before."""
        held, logs = self.known.get(lang, (np.empty(0, np.uint64), np.empty(0)))
        at = np.searchsorted(held, own)
        old = at < len(held)
        old[old] = held[at[old]] == own[old]
        out = np.empty(len(own))
        out[old] = logs[at[old]]
        new = np.flatnonzero(~old)
        if len(new):
            out[new] = self.letter_logs([c[new] for c in columns], lang)
            if sum(len(k) for k, _ in self.known.values()) + len(new) > HELD_GRAMS:
                self.known.clear()
            else:
                self.known[lang] = np.insert(held, at[new], own[new]), np.insert(logs, at[new], out[new])
        return out

    def letter_logs(self, columns: list[np.ndarray], lang: str | None) -> np.ndarray:
        """log10 probability of each last letter behind those before it, given as columns of ``endings``."""
        key = language_hash(lang)
        letters = self.shares.find(np.array([letters_key(lang)], np.uint64), 0.0)[1][0]
        p = np.full(len(columns[0]), 1.0 / (letters + 1))
        at = np.arange(len(p))
        for n in range(1, ORDER + 1):
            # The n-gram that ends with the letter, where the word has room for it, and its context.
            at = at[columns[n - 2][at] != ord(BEGIN)] if n > 1 else at
            gram = [columns[k][at] for k in range(n)]
            share = found(self.shares, gram_hashes(gram[::-1], key), 0.0)
            left = found(self.left, gram_hashes(gram[:0:-1], key), 1.0)
            p[at] = share + left * p[at]
        return np.log10(p)


def found(table: Opened, keys: np.ndarray, default: float) -> np.ndarray:
    """The values of keys that may repeat; one key is for all."""
    own, back = np.unique(keys, return_inverse=True)
    return table.find(own, default)[1][back]


_SPELLERS: dict[str, Speller] = {}


def speller(model: Spelling) -> Speller:
    if model.shares.folder not in _SPELLERS:
        _SPELLERS.clear()
        _SPELLERS[model.shares.folder] = Speller(model)
    return _SPELLERS[model.shares.folder]


SCHEMA = "id {kind}, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, log_perplexity double, word_log_perplexity double"


def token_places(order: lm.Scorer, words: list[bytes], tags: np.ndarray) -> np.ndarray:
    """The numbers that the model of words has for words, given with the hashes of their languages."""
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(bytes.lower, words)), np.uint64, len(words)) ^ tags
    distinct, back = np.unique(hashes, return_inverse=True)
    return order.words.find(distinct)[0][back] + 1


def measured(docs: DataFrame, model: Spelling, words: lm.Model, id_col: str = "doc_id") -> DataFrame:
    """Per row: the base features, ``base_failed``, ``log_perplexity`` (per letter, log10) and
    ``word_log_perplexity`` (per word and end of text, by the other texts). The texts are those of the models."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, numbers, known = speller(model), Numbers(), {}
        for batch in batches:
            for rows, (langs, texts) in slices(batch.column(1), batch.column(2)):
                n = rows.stop - rows.start
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(rows.start, n), batch.column(1).slice(rows.start, n), *measure(s, numbers, known, langs, texts)], [x.split()[0] for x in SCHEMA.split(", ")])
                if numbers.full or len(known) > 64:
                    numbers, known = Numbers(), {}

    def measure(s: Speller, numbers: Numbers, known: dict[str | None, np.ndarray], langs: list, texts: list) -> list[pa.Array]:
        parts = numbers.of([words_of(t) for t in texts])
        features = [base_features(t, p) for t, p in zip(texts, parts, strict=True)]
        out, order, tokens = np.zeros(len(texts)), lm.scorer(words), [np.empty(0, np.int64)] * len(texts)
        whose: dict[str | None, list[int]] = defaultdict(list)
        for i, lang in enumerate(langs):
            whose[lang].append(i)
        fresh = []
        for lang, own in whose.items():
            # Scores, letters and places of words met before are kept; zero letters mark the others.
            now = np.zeros((3, len(numbers.own)))
            if lang in known:
                now[:, : known[lang].shape[1]] = known[lang]
            known[lang] = now
            used = np.flatnonzero(np.bincount(np.concatenate([parts[i] for i in own]), minlength=len(numbers.own)))
            new = used[now[1, used] == 0]
            if len(new):
                now[0, new], now[1, new] = s.word_scores([numbers.own[k] for k in new.tolist()], lang)
            fresh.append(new)
        tags = [np.uint64(lm.tag_hash(lang)) for lang in whose]
        places = token_places(order, [numbers.own[k] for k in np.concatenate(fresh).tolist()], np.repeat(tags, [len(x) for x in fresh]))
        ends = order.words.find(np.array(tags) ^ lm.END)[0] + 1
        at = 0
        for (lang, own), new, end in zip(whose.items(), fresh, ends, strict=True):
            known[lang][2, new] = places[at : at + len(new)]
            at += len(new)
            place = known[lang][2].astype(np.int64)
            for i in own:
                tokens[i] = np.append(place[parts[i]], end)
            who = [i for i in own if len(parts[i])]
            out[who] = [-known[lang][0, parts[i]].sum() / known[lang][1, parts[i]].sum() for i in who]
        sizes = np.array([len(t) for t in tokens])
        by_words = -order.others_score(np.concatenate(tokens), sizes) / sizes
        columns = [pa.array([f[k] for f in features], pa.int64()) for k in range(5)]
        return [*columns, pa.array([not passes(f[0], f[4]) for f in features]), pa.array(out), pa.array(by_words)]

    src = docs.select(F.col(id_col).alias("id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    small_batches(src.sparkSession)
    return src.mapInArrow(run, SCHEMA.format(kind=dict(src.dtypes)["id"]))


def judged(docs: DataFrame, id_col: str = "doc_id", band: float = BAND) -> DataFrame:
    """Per row: the features, the perplexities, the bounds of its language and ``kept``."""
    with shuffles_freed(docs.sparkSession):
        texts = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
        rows = stored(measured(docs, write_model(docs), lm.train(texts, tag_col="lang", least=2), id_col), "measured")
        sound = rows.where("not base_failed")
        few = F.broadcast if rows.select("lang").distinct().count() <= BROADCAST_ROWS else lambda df: df
        middle = lambda c: F.percentile_approx(c, 0.5, F.lit(10000))
        centre = sound.groupBy(F.col("lang").alias("l")).agg(middle("log_perplexity").alias("centre"), middle("word_log_perplexity").alias("word_centre"))
        far, word_far = F.col("log_perplexity") - F.col("centre"), F.col("word_log_perplexity") - F.col("word_centre")
        side = lambda c: F.greatest(1.4826 * F.coalesce(F.percentile_approx(F.when(c >= 0, c), 0.5, F.lit(10000)), F.lit(0.0)), F.lit(LEAST_UNIT))
        units = sound.join(few(centre), F.col("lang").eqNullSafe(F.col("l"))).groupBy("l", "centre", "word_centre").agg(side(-far).alias("below"), side(far).alias("above"), side(word_far).alias("word_above"))
        bounds = stored(units.select("l", (F.col("centre") - band * F.col("below")).alias("lower_bound"), (F.col("centre") + band * F.col("above")).alias("upper_bound"), (F.col("word_centre") + band * F.col("word_above")).alias("word_upper_bound")), "bands")  # a row per language
    out = rows.join(few(bounds), F.col("lang").eqNullSafe(F.col("l")), "left")
    inside = F.col("log_perplexity").between(F.col("lower_bound"), F.col("upper_bound")) & (F.col("word_log_perplexity") <= F.col("word_upper_bound"))
    return out.select(F.col("id").alias(id_col), *rows.columns[2:], "lower_bound", "upper_bound", "word_upper_bound", (~F.col("base_failed") & F.coalesce(inside, F.lit(False))).alias("kept"))
