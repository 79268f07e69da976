"""Interpolated modified Kneser-Ney language model (operator 3).

Tokens are the words of a text, A to Z lower-cased, then one end. The model has two orders, which
are what its counts can be kept of for whole corpora (README has the figures): pairs of tokens, and
tokens by the number of different tokens before them, interpolated with the uniform distribution over
the vocabulary and one class of unknown words. Discounts for counts 1, 2 and more follow Chen and Goodman.

Counting. Pass one counts tokens by XXH64; the sorted hash arrays give every token a dense number,
its place. Pass two counts pairs of numbers exactly: a pair is one number of 64 bits, and if the
vocabulary has more than 2 ** 32 tokens, so that 64 bits don't hold all pairs, first tokens are dealt
to groups of which they do. Counts have as many bytes as they need. What the estimate needs of
pairs (per first token, how many pairs occur once, twice, more often; per second token, how many
there are) is summed per shard and then per range of numbers. Nothing of the size of the vocabulary
is ever collected; the driver sees one row of totals per shard.

Scoring. Workers memory-map the arrays of the shared folder and look up the distinct keys of a few
megabytes of text at a time by binary search.

Defined cases. A null text counts as empty and has the end only. Null ids belong to the fold of the
empty text. Without training rows every score is that of a vocabulary of unknown words only:
probability one. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import fold_remainder, map_batches, scratch, small_batches, stored
from tessera.llm.hashstore import COUNT, Counts, Opened, Shards, add_up, blobs_of, gathered, map_arrays, width_of, write_arrays

#: No word has white space, so this stands for the end of a text.
END = np.uint64(xxhash.xxh64_intdigest(b"\n"))
#: Bytes of text per shard, and the most shards.
SHARD_BYTES, MIN_BITS, MAX_BITS = 1 << 23, 4, 18
#: Bytes of text that are looked at together.
SLICE_BYTES = 1 << 22


@dataclass
class Pairs:
    """Pairs of token numbers (0 to ``n`` - 1) as one number within a group of first tokens."""

    n: int
    key_bits: int = 64

    @property
    def span(self) -> int:
        """First tokens of a group."""
        return max(1, (1 << self.key_bits) // self.n)

    @property
    def groups(self) -> int:
        return -(-self.n // self.span)

    def keys(self, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Group and number of each pair."""
        span = min(self.span, 1 << 62)
        return before // span, (before % span).astype(np.uint64) * np.uint64(self.n) + after.astype(np.uint64)

    def parts(self, group: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = np.uint64(self.n)
        return keys // n + np.uint64(group * self.span if self.groups > 1 else 0), keys % n


def slices(texts: list[str | None]) -> Iterator[list[bytes]]:
    """The texts in lower case, a few megabytes at a time."""
    held, size = [], 0
    for t in texts:
        held.append((t or "").encode().lower())
        size += len(held[-1])
        if size > SLICE_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def tag_hash(tag: str | None) -> int:
    """What the hashes of the tokens of a kind of texts (of a language) are changed by."""
    return xxhash.xxh64_intdigest((tag or "").encode(), 5 if tag is None else 4)


def tagged_slices(columns: list[pa.Array]) -> Iterator[tuple[list[bytes], np.ndarray | None]]:
    """The texts as in ``slices``, with the hashes of their tags where there is a second column."""
    at, known = 0, {}
    tags = columns[1].to_pylist() if len(columns) > 1 else None
    for part in slices(columns[0].to_pylist()):
        own = None
        if tags is not None:
            known.update((t, tag_hash(t)) for t in set(tags[at : at + len(part)]) - known.keys())
            own = np.array([known[t] for t in tags[at : at + len(part)]], np.uint64)
        yield part, own
        at += len(part)


def token_hashes(texts: list[bytes], tags: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, and the number of tokens of each text. Tokens of texts of different tags differ."""
    lists = [t.split() for t in texts]
    sizes = np.array([len(w) + 1 for w in lists], np.int64)
    out = np.full(int(sizes.sum()), END, np.uint64)
    digest, at = xxhash.xxh64_intdigest, 0
    for w, n in zip(lists, sizes.tolist(), strict=True):
        out[at : at + n - 1] = np.fromiter(map(digest, w), np.uint64, n - 1)
        at += n
    return out if tags is None else out ^ np.repeat(tags, sizes), sizes


def previous(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The token before each token; 0 before the first of a text."""
    before = np.concatenate([[0], ids[:-1]])
    before[np.cumsum(sizes) - sizes] = 0
    return before


def discounts(n: list[int]) -> list[float]:
    """D(1), D(2), D(3 and more) from the numbers of n-grams seen 1, 2, 3, 4 times.

    Where the formula gives nothing between 0 and k (few counts), k / 2 takes its place, so that
    something is always left for what was not seen.
    """
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
    d = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else 0.0 for k in (1, 2, 3)]
    return [x if 0 < x < k else k / 2 for k, x in enumerate(d, 1)]


def of_count(d: list[float], c: np.ndarray) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(c, 3)]


@dataclass
class Model:
    """What workers need: the arrays' places, and the totals."""

    words: Shards
    pairs: list[Shards]
    folder: str
    range_bits: int
    n_tokens: int
    n_words: int
    n_texts: int
    n_pairs: int
    d_pair: list[float]
    d_word: list[float]
    seen: list[int]  # tokens that have one, two, more different tokens before them
    numbers: Pairs
    dense_kind: str

    @property
    def rest(self) -> float:
        """What the lowest order leaves to the uniform distribution."""
        return sum(d * n for d, n in zip(self.d_word, self.seen, strict=True)) / self.n_pairs if self.n_pairs else 1.0


def width(n_words: int, bits: int) -> int:
    return -(-(n_words + 1) // (1 << bits))


def train(texts: DataFrame, text_col: str = "text", key_bits: int = 64, tag_col: str | None = None, least: int = 1) -> Model:
    """Counts and estimates the model of all rows of ``texts``. ``key_bits`` bounds the numbers of pairs.

    With ``tag_col``, texts of different tags have no token in common. All pairs are counted; written are those
    that occur ``least`` times (``others_score`` needs none that occurs once).
    """
    spark = texts.sparkSession
    small_batches(spark)
    src = texts.select(F.col(text_col).cast("string").alias("text"), *([F.col(tag_col).cast("string").alias("tag")] if tag_col else []))
    size = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(MAX_BITS, max(MIN_BITS, math.ceil(math.log2(max(1, size / SHARD_BYTES)))))
    folder = scratch(spark, "lm")
    parts = 1 << bits

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(bits, mixed=False)
        for batch in batches:
            for part, tags in tagged_slices(batch.columns):
                counts.add(token_hashes(part, tags)[0])
                if counts.full:
                    yield from counts.blobs()
        yield from counts.blobs()

    def write_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, (keys, n) in gathered(batches, 1):
            write_arrays(f"{folder}/words/{s:06d}", keys, n.astype("<u8"))
            yield pa.RecordBatch.from_pylist([{"shard": s, "size": len(keys), "total": int(n.sum())}])

    blobs = "shard long, blob binary"
    done = src.mapInArrow(count_words, blobs).repartition(parts, "shard").mapInArrow(write_words, "shard long, size long, total long").collect()  # a row per shard
    sizes = [0] * parts
    for r in done:
        sizes[r["shard"]] = r["size"]
    words = Shards(f"{folder}/words", bits, False, sizes, ["<u8"])
    n_words = sum(sizes)
    step = width(n_words, bits)
    numbers = Pairs(n_words + 1, key_bits)
    dense_kind = "<u4" if n_words < (1 << 32) - 1 else "<u8"  # no token has more neighbours than there are tokens

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = words.open()
        counts = defaultdict(lambda: Counts(bits, mixed=True))

        def emptied(g: int) -> Iterator[pa.RecordBatch]:
            for b in counts.pop(g).blobs():
                yield pa.RecordBatch.from_arrays([pc.add(b.column(0), g * parts), b.column(1)], ["shard", "blob"])

        for batch in batches:
            for part, tags in tagged_slices(batch.columns):
                ids, sizes = token_numbers(known, part, tags)
                group, keys = numbers.keys(previous(ids, sizes), ids)
                for g in np.unique(group).tolist() if numbers.groups > 1 else [0]:
                    counts[g].add(keys[group == g] if numbers.groups > 1 else keys)
                    if counts[g].full:
                        yield from emptied(g)
        for g in list(counts):
            yield from emptied(g)

    def write_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["shard", "blob", "size", "written", "n1", "n2", "n3", "n4"]

        def row(shard: int, blob: bytes | None, size: int, written: int, n: list[int]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([blob], pa.binary()), *(pa.array([x], pa.int64()) for x in (size, written, *n))], names)

        for s, (keys, n) in gathered(batches, 1):
            often = n >= least
            write_arrays(f"{folder}/pairs/{s // parts}/{s % parts:06d}", keys[often], n[often].astype(width_of(n)))
            # Row -1 - s: totals of this shard. Row r: sums for the token numbers of range r.
            yield row(-1 - s, None, len(keys), int(often.sum()), [int((n == k).sum()) for k in (1, 2, 3, 4)])
            before, after = numbers.parts(s // parts, keys)
            zero = np.zeros(len(keys), np.int64)
            one = zero + 1
            sums = add_up(np.concatenate([before, after]), *(np.concatenate(x) for x in (((n == 1).astype(np.int64), zero), ((n == 2).astype(np.int64), zero), ((n > 2).astype(np.int64), zero), (zero, one))))
            for batch in blobs_of((sums[0] // np.uint64(step)).astype(np.int64), *sums):
                k = batch.num_rows
                yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.nulls(k, pa.int64())] * 6], names)

    every = parts * numbers.groups
    counted = stored(src.mapInArrow(count_pairs, blobs).repartition(every, "shard").mapInArrow(write_pairs, "shard long, blob binary, size long, written long, n1 long, n2 long, n3 long, n4 long"), "lm-pairs")
    sizes, n, n_pairs = [0] * every, [0] * 4, 0
    for r in counted.where("shard < 0").drop("blob").collect():  # a row per shard
        sizes[-1 - r["shard"]] = r["written"]
        n_pairs += r["size"]
        n = [a + r[f"n{k}"] for k, a in enumerate(n, 1)]
    pairs = [Shards(f"{folder}/pairs/{g}", bits, True, sizes[g * parts : (g + 1) * parts], [COUNT]) for g in range(numbers.groups)]

    def write_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, (keys, *columns) in gathered(batches, 4):
            dense = [np.zeros(step, dense_kind) for _ in columns]
            at = (keys - np.uint64(r * step)).astype(np.int64)
            for d, c in zip(dense, columns, strict=True):
                d[at] = c
            write_arrays(f"{folder}/ranges/{r:06d}", *dense)
            last = dense[3]
            yield pa.RecordBatch.from_pylist([{f"n{k}": int((last == k).sum()) for k in (1, 2, 3, 4)} | {"more": int((last > 2).sum())}])

    rows = stored(counted.where("shard >= 0").select("shard", "blob").repartition(parts, "shard").mapInArrow(write_ranges, "n1 long, n2 long, n3 long, n4 long, more long"), "lm-ranges")
    sums = rows.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in rows.columns)).first()
    return Model(words, pairs, f"{folder}/ranges", bits, sum(r["total"] for r in done), n_words, src.count(), n_pairs, discounts(n), discounts(list(sums[:4])), [sums[0], sums[1], sums[4]], numbers, dense_kind)


def token_numbers(known: Opened, texts: list[bytes], tags: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all tokens (from 1; -1: unknown), and the number of tokens of each text."""
    hashes, sizes = token_hashes(texts, tags)
    distinct, back = np.unique(hashes, return_inverse=True)
    place = known.find(distinct)[0]
    return np.where(place < 0, -1, place + 1)[back], sizes


class Scorer:
    """The mapped model in a worker."""

    def __init__(self, model: Model) -> None:
        self.m, self.words, self.pairs = model, model.words.open(), [p.open() for p in model.pairs]
        self.step = width(model.n_words, model.range_bits)
        self.maps: dict[int, list[np.ndarray]] = {}

    def of_numbers(self, ids: np.ndarray) -> list[np.ndarray]:
        """For distinct sorted numbers: pairs seen once, twice, more often behind it; tokens before it."""
        out = [np.zeros(len(ids), np.int64) for _ in range(4)]
        part = ids // self.step
        edges = np.flatnonzero(np.diff(part, prepend=-1, append=-1)) if len(ids) else []
        for a, z in zip(edges, edges[1:], strict=False):
            r = int(part[a])
            if r not in self.maps:
                self.maps[r] = map_arrays(f"{self.m.folder}/{r:06d}", self.step, [self.m.dense_kind] * 4)
            for o, c in zip(out, self.maps[r], strict=True):
                o[a:z] = c[ids[a:z] - r * self.step]
        return out

    def pair_counts(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        group, every = self.m.numbers.keys(before, after)
        out = np.zeros(len(every), np.int64)
        for g, own in enumerate(self.pairs):
            at = slice(None) if len(self.pairs) == 1 else np.flatnonzero(group == g)
            keys, where = np.unique(every[at], return_inverse=True)
            out[at] = own.find(keys, 0)[1].astype(np.int64)[where]
        return out

    def score(self, texts: list[bytes]) -> list[np.ndarray]:
        """Per text: tokens, known tokens, base score, score."""
        m = self.m
        hashes, sizes = token_hashes(texts)
        distinct, back = np.unique(hashes, return_inverse=True)
        place, count = self.words.find(distinct, 0)
        ids = np.where(place < 0, -1, place + 1)
        begins = np.cumsum(sizes) - sizes
        known = np.add.reduceat((count > 0)[back].astype(np.int64), begins)
        base = np.add.reduceat(np.log10((count + 1.0) / (m.n_tokens + (m.n_words + 1.0)))[back], begins)

        uniform = 1.0 / (m.n_words + 1)
        numbers = np.unique(np.concatenate([[0], ids[ids > 0]])) if m.n_words else np.empty(0, np.int64)
        once, twice, more, before = self.of_numbers(numbers)
        at = np.searchsorted(numbers, np.maximum(ids, 0))
        lower = np.full(len(distinct), m.rest * uniform)
        left, total_of = np.ones(len(distinct)), np.zeros(len(distinct), np.int64)
        if m.n_words:
            have = ids > 0
            n = before[at[have]]
            lower[have] += np.maximum(n - of_count(m.d_word, n), 0) / m.n_pairs
            d = m.d_pair
            spare = d[0] * once + d[1] * twice + d[2] * more
            left[have] = spare[at[have]] / count[have]
            total_of[have] = count[have]
            first_left, first_total = spare[0] / m.n_texts, m.n_texts

        token = ids[back]
        prior = previous(token, sizes)
        context_left, context_total = np.concatenate([[1.0], left[back][:-1]]), np.concatenate([[0], total_of[back][:-1]])
        if m.n_words:
            context_left[begins], context_total[begins] = first_left, first_total
        p = context_left * lower[back]
        use = (token > 0) & (prior >= 0)
        c = self.pair_counts(prior[use], token[use])
        p[use] += np.maximum(c - of_count(m.d_pair, c), 0) / np.maximum(context_total[use], 1)
        score = np.add.reduceat(np.log10(p), begins)
        return [sizes, known, base, score]


    def others_score(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """log10 probability of each text, given as its token numbers, by the model of all other texts:
        counts without the text's own, discounts as they are. The texts have to be among those of the
        model; a pair that was not written for being rare has no count but the text's own."""
        m, n_texts = self.m, len(sizes)
        numbers, local = np.unique(np.concatenate([ids, [0]]), return_inverse=True)
        before, after = previous(local[:-1], sizes), local[:-1]
        text = np.repeat(np.arange(n_texts), sizes)
        size = np.uint64(len(numbers))
        pair = before.astype(np.uint64) * size + after.astype(np.uint64)
        if n_texts * len(numbers) ** 2 < 1 << 64:
            # The sorted number of text and pair says which they are.
            every = np.sort(text.astype(np.uint64) * size**2 + pair)
            at = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
            own = np.diff(at, append=len(every))
            row, after = (x.astype(np.int64) for x in np.divmod(every[at], size))
            text, before = np.divmod(row, len(numbers))
        else:
            pair = np.unique(pair, return_inverse=True)[1].astype(np.uint64)
            _, at, own = np.unique(text.astype(np.uint64) * (pair.max() + np.uint64(1)) + pair, return_index=True, return_counts=True)
            text, before, after = text[at], before[at], after[at]
        every = np.maximum(self.pair_counts(numbers[before], numbers[after]), own)
        c = every - own  # in other texts
        once, twice, more, preceding = self.of_numbers(numbers)

        # Contexts: what they leave to the lower order. Pairs are in the order of text and context.
        first = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (before[1:] != before[:-1])]))
        of = np.repeat(np.arange(len(first)), np.diff(first, append=len(text)))
        total = self.totals(numbers)[before[first]] - np.add.reduceat(own, first)
        spare = np.zeros(len(first))
        for k, (d, all_of) in enumerate(zip(m.d_pair, (once, twice, more), strict=True), 1):
            spare += d * (all_of[before[first]] - np.add.reduceat((np.minimum(every, 3) == k).astype(np.int64) - (np.minimum(c, 3) == k), first))
        left = np.where(total > 0, spare / np.maximum(total, 1), 1.0)

        # The lower order: different tokens before a token in other texts.
        alone = c == 0
        places, back = np.unique(text.astype(np.uint64) * size + after.astype(np.uint64), return_inverse=True)
        whose, which = (places // size).astype(np.int64), (places % size).astype(np.int64)
        n = preceding[which]
        others = n - np.bincount(back, alone, len(places)).astype(np.int64)
        n_pairs = m.n_pairs - np.bincount(text, alone, n_texts).astype(np.int64)
        spread = np.zeros(n_texts)
        for k, (d, all_of) in enumerate(zip(m.d_word, m.seen, strict=True), 1):
            spread += d * (all_of - np.bincount(whose, np.minimum(n, 3) == k, n_texts) + np.bincount(whose, np.minimum(others, 3) == k, n_texts))
        rest = np.where(n_pairs > 0, spread / np.maximum(n_pairs, 1), 1.0)
        lower = np.maximum(others - of_count(m.d_word, others), 0) / np.maximum(n_pairs, 1)[whose] + rest[whose] / (m.n_words + 1)
        p = np.maximum(c - of_count(m.d_pair, c), 0) / np.maximum(total, 1)[of] + left[of] * lower[back]
        return np.bincount(text, own * np.log10(p), n_texts)

    def totals(self, numbers: np.ndarray) -> np.ndarray:
        """How often each of the numbers, which are sorted, is followed by a token."""
        out = np.zeros(len(numbers), np.int64)
        shard = np.searchsorted(self.words.offsets, numbers - 1, "right") - 1
        edges = np.flatnonzero(np.diff(shard, prepend=-2, append=-2))
        for a, z in zip(edges, edges[1:], strict=False):
            if numbers[a:z][-1]:
                s = int(shard[a])
                out[a:z] = self.words.arrays(s)[1][numbers[a:z] - 1 - self.words.offsets[s]]
        return np.where(numbers == 0, self.m.n_texts, out)


_SCORERS: dict[str, Scorer] = {}


def scorer(model: Model) -> Scorer:
    """The model as this worker has it mapped; one at a time."""
    if model.folder not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[model.folder] = Scorer(model)
    return _SCORERS[model.folder]


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, n_known, train_tokens, base_score, score."""

    def run(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        s, at = scorer(model), 0
        for part in slices(batch.column(1).to_pylist()):
            n, known, base, score = s.score(part)
            ids = batch.column(0).slice(at, len(part))
            at += len(part)
            yield pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(known), pa.array(np.full(len(part), model.n_tokens)), pa.array(base), pa.array(score)], ["id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(src, run, f"id {dict(src.dtypes)['id']}, n_tokens long, n_known long, train_tokens long, base_score double, score double").withColumnRenamed("id", id_col)


def held_out_fold(key: Column) -> Column:
    return fold_remainder(key, 7) == 2
