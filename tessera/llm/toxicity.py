"""Toxicity scores from a weighted lexicon (operator 6).

Folding. Compatibility forms are unified (NFKC), case is folded, look-alike letters of other
scripts become Latin ones, and digits or signs that stand for letters next to letters become
those; what is no letter or digit becomes a blank. Accents stay, as they tell words of one
language from those of another. Lexicon and texts are folded alike.

Lexicon. Learned from labelled documents of the training fold, of which at most about
``max_train_rows`` are used (picked by a hash of the id). Terms are whole words and the first 4
to 8 letters of longer words. The weight of a term is the logarithm of the ratio of its shares
among toxic and other documents; a term needs ``min_docs`` toxic documents, in which it must stand
between at least ``min_contexts`` different pairs of words, so that words of a text with many
copies are no terms. Exception phrases are a term with the word before or behind it, met in
``min_docs`` documents none of which is toxic; a match inside one counts nothing.

Score. All terms and phrases are found in one pass by an Aho-Corasick automaton. The weights of
the matches are summed, and set against the number of words; a logistic curve fitted on the same
training rows makes that a score between 0 and 1.

Defined cases. A null or empty text has no matches and gets the score of no matches. Labels that
are null, and rows of ``labels`` for ids that have none or several texts, are handled as the join
on the id gives them; null ids never match. Without training rows of both labels the lexicon is
empty and all scores are equal and below the limit. An empty table gives an empty result. Other
columns are ignored by ``scores`` and kept by ``clean``.
"""

from __future__ import annotations

import math
import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import fold_remainder, in_slices, map_batches, small_batches, stored

MAX_TRAIN_ROWS = 20_000
MAX_TERMS = 3_000
PREFIXES = (4, 5, 6, 7, 8)
LIMIT = 0.7

#: Letters of other scripts, and signs, that look like Latin letters (after case folding).
LOOKALIKES = dict(zip("абвгдеѕзиіїјкӏмнопрстуүхһԁԛԝαβγεηικνορτυχωɡıⅼ", "abbrdessiiijklmhonpctyyxhdqwabyeniknoptuxwgil", strict=True))
LOOKALIKES |= dict(zip("ёєѐѝќўґҝҡңөұҳθσϲϳոսցզհօյքա", "eeeikyrkknoyxoocjnugqhojpw", strict=True))
SUBSTITUTES = dict(zip("0134578@$!|", "oieastbasii", strict=True))
#: Unicode's names of letters that are Latin ones in another dress, and the blocks that have them.
_DRESSED = re.compile(r"(?:LATIN (?:LETTER SMALL CAPITAL|SMALL LETTER|SMALL LETTER REVERSED|SMALL LETTER TURNED)|NEGATIVE (?:SQUARED|CIRCLED) LATIN CAPITAL LETTER|REGIONAL INDICATOR SYMBOL LETTER) ([A-Z])(?: WITH [A-Z -]+)?")
_BLOCKS = (0x80, 0x300), (0x1D00, 0x1DC0), (0x2C60, 0x2C80), (0xA720, 0xAB70), (0x1F130, 0x1F200)


def dressed() -> dict[str, str]:
    """Letters that Unicode describes as a Latin letter and that it does not compose of one and an accent."""
    out = {}
    for c in (chr(i) for a, z in _BLOCKS for i in range(a, z)):
        plain = unicodedata.normalize("NFKD", c) == c and _DRESSED.fullmatch(unicodedata.name(c, ""))
        if plain and c.casefold() == c:
            out[c] = plain[1].lower()
    return out


LOOKALIKES |= dressed()

_SUBSTITUTED = re.compile(r"[0134578@$!|]+(?=[^\W\d_])|(?<=[^\W\d_])[0134578](?![\w$@!|])")
_SIGN = re.compile(r"[0134578@$!|]")
_GAPS = re.compile(r"[\W_]+")
#: Invisible characters, and marks that are left over where no letter has them.
_UNSEEN = re.compile("[\u00ad\u0300-\u036f\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]+")
_ASCII = bytes(c if chr(c).isalnum() and c < 128 else 32 for c in range(256))
_LOOKALIKE = str.maketrans(LOOKALIKES)


def fold(text: str | None) -> str:
    """The words of a text in folded form, with one blank before, between and behind them."""
    t = text or ""
    if not t.isascii():
        t = _UNSEEN.sub("", unicodedata.normalize("NFKC", t)).casefold().translate(_LOOKALIKE)
    else:
        t = t.lower()
    if _SIGN.search(t):
        t = _SUBSTITUTED.sub(lambda m: "".join(SUBSTITUTES[c] for c in m[0]), t)
    if t.isascii():
        return f" {' '.join(t.encode().translate(_ASCII).decode().split())} "
    return f" {' '.join(_GAPS.sub(' ', t).split())} "


def terms_of(word: str) -> list[str]:
    return [f" {word} ", *(f" {word[:n]}" for n in PREFIXES if len(word) > n)]


@dataclass
class Lexicon:
    """Weights by folded term, exception phrases, and the logistic curve over two features."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    curve: tuple[float, float, float] = (-3.0, 2.0, 1.0)
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def automaton(self) -> ahocorasick.Automaton:
        a = ahocorasick.Automaton()
        for term, w in self.weights.items():
            a.add_word(term, (len(term), w))
        for phrase in self.exceptions:
            a.add_word(phrase, (len(phrase), None))
        if len(a):
            a.make_automaton()
        return a


_AUTOMATA: dict[str, ahocorasick.Automaton] = {}


def automaton_of(lexicon: Lexicon) -> ahocorasick.Automaton:
    """The automaton as this worker has it; one at a time."""
    if lexicon.name not in _AUTOMATA:
        _AUTOMATA.clear()
        _AUTOMATA[lexicon.name] = lexicon.automaton()
    return _AUTOMATA[lexicon.name]


def features(text: str | None, automaton: ahocorasick.Automaton) -> tuple[float, float, int]:
    """log(1 + weight), log(1 + weight per 100 words), number of matches."""
    t = fold(text)
    if not len(automaton):
        return 0.0, 0.0, 0
    safe: list[tuple[int, int]] = []
    at: dict[int, tuple[int, float]] = {}
    for end, (size, w) in automaton.iter(t):
        begin = end - size + 1
        if w is None:
            safe.append((begin, end))
        elif begin not in at or at[begin][1] < w:
            at[begin] = end, w  # of terms that begin alike the heaviest counts
    if safe:
        at = {b: (e, w) for b, (e, w) in at.items() if not any(x <= b and e <= y for x, y in safe)}
    weight = sum(w for _, w in at.values())
    return math.log1p(weight), math.log1p(100 * weight / max(1, t.count(" ") - 1)), len(at)


def probability(x: float, y: float, curve: tuple[float, float, float]) -> float:
    z = curve[0] + curve[1] * x + curve[2] * y
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int, held_out: Column, id_col: str, text_col: str) -> DataFrame:
    """``text``, ``y`` of labelled rows outside the held-out fold, at most about ``max_rows``."""
    known = labels.where(F.col("toxic").isin(0, 1)).select(F.col("doc_id").alias("_key"), F.col("toxic").alias("_y"))
    known = known.where(~held_out).groupBy("_key").agg(F.max("_y").alias("_y"))
    share = min(1.0, max_rows / max(1, known.count()))
    part = known.where(F.pmod(F.xxhash64("_key"), F.lit(1_000_000)) < int(share * 1_000_000))
    # At most about max_rows rows of 12 bytes: a bound that no input exceeds.
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(part), F.col("_id") == F.col("_key"))
    one = F.min(F.struct(F.xxhash64("text").alias("sha"), "text")).alias("one")
    return rows.groupBy("_id", "_y").agg(one).select("one.text", F.col("_y").alias("y"))


def count_terms(train: DataFrame) -> DataFrame:
    """``term``, ``a``, ``b``: toxic and other documents with it; ``contexts`` in toxic ones."""

    def run(whole: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        # A few documents at a time, as the terms of all words take many times the text's memory.
        for i in range(0, whole.num_rows, 512):
            yield of_slice(whole.slice(i, 512))

    def of_slice(batch: pa.RecordBatch) -> pa.RecordBatch:
        other: Counter[str] = Counter()
        seen: dict[tuple[str, int], int] = {}
        for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            w = fold(text).split()
            if not y:
                other.update({t for x in set(w) for t in terms_of(x)})
                continue
            own: dict[str, int] = {}
            for k, x in enumerate(w):
                for t in terms_of(x):
                    if t not in own:
                        around = (w[k - 1] if k else "") + " " + (w[k + 1] if k + 1 < len(w) else "")
                        own[t] = xxhash.xxh64_intdigest(around.encode()) >> 1
            for pair in own.items():
                seen[pair] = seen.get(pair, 0) + 1
        names = [*other, *(t for t, _ in seen)]
        return pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([0] * len(other) + list(seen.values()), pa.int64()), pa.array([*other.values(), *[0] * len(seen)], pa.int64()), pa.array([None] * len(other) + [c for _, c in seen], pa.int64())],
            ["term", "a", "b", "around"],
        )

    rows = map_batches(train.select("text", "y"), run, "term string, a long, b long, around long")
    each = rows.groupBy("term", "around").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return each.groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.count("around").alias("contexts"))


def count_phrases(train: DataFrame, weights: dict[str, float]) -> DataFrame:
    """``phrase``, ``a``, ``b``: a term's word with the word before or behind it."""
    known = frozenset(weights)

    def run(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        n: dict[str, list[int]] = {}
        for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            w = fold(text).split()
            own = set()
            for k, x in enumerate(w):
                if not known.isdisjoint(terms_of(x)):
                    own |= {f" {a} {b} " for a, b in zip(w[max(0, k - 1) : k + 1], w[max(1, k) : k + 2], strict=False)}
            for p in own:
                n.setdefault(p, [0, 0])[not y] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array([v[0] for v in n.values()], pa.int64()), pa.array([v[1] for v in n.values()], pa.int64())], ["phrase", "a", "b"])

    return map_batches(train.select("text", "y"), run, "phrase string, a long, b long").groupBy("phrase").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def fit_curve(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 1e-2) -> tuple[float, float, float]:
    """Logistic regression by Newton steps."""
    m = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(3)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(m @ w, -30, 30)))
        hess = (m * (p * (1 - p))[:, None]).T @ m + ridge * np.eye(3)
        step = np.linalg.solve(hess, m.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(w.tolist())


def fit(docs: DataFrame, labels: DataFrame, held_out: Column | None = None, id_col: str = "doc_id", text_col: str = "text", max_train_rows: int = MAX_TRAIN_ROWS, min_docs: int = 5, min_contexts: int = 4, min_weight: float = 2.5) -> Lexicon:
    """Learns the lexicon and the curve. ``held_out`` is a condition on the label rows' ``_key``."""
    held = F.lit(False) if held_out is None else held_out
    train = stored(training_rows(docs, labels, max_train_rows, held, id_col, text_col), "toxic-train")
    size = {r.y: r.n for r in train.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(size) < 2:
        return Lexicon()
    share = lambda c, n: F.log((F.col(c) + 0.5) / (n + 1.0))
    counted = count_terms(train).where((F.col("a") >= min_docs) & (F.col("contexts") >= min_contexts)).withColumn("w", share("a", size[1]) - share("b", size[0])).where(F.col("w") >= min_weight)
    rows = counted.collect()  # terms of at least min_docs of max_train_rows documents
    picked = {r.term: r.w for r in rows}
    # A longer term adds nothing to its own beginning, if that is about as telling.
    weights = {t: w for t, w in picked.items() if not any(picked.get(t[: n + 1], 0) >= 0.8 * w for n in PREFIXES if len(t.rstrip()) > n + 1)}
    exceptions = []
    if any(r.b for r in rows if r.term in weights):
        exceptions = [r.phrase for r in count_phrases(train, weights).where(f"a = 0 and b >= {min_docs}").collect()]
    lexicon = Lexicon(weights, exceptions)

    def measured(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        a = automaton_of(lexicon)
        f = [features(t, a) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([v[0] for v in f], pa.float64()), pa.array([v[1] for v in f], pa.float64()), batch.column(1)], ["u", "v", "y"])

    seen = map_batches(train.select("text", F.col("y").cast("double")), measured, "u double, v double, y double").toPandas()  # bounded by max_train_rows
    lexicon.curve = fit_curve(seen[["u", "v"]].to_numpy(), seen["y"].to_numpy())
    return lexicon


def score_column(text: Column, lexicon: Lexicon) -> Column:
    """A struct of ``score`` and ``n_matches`` for a text column."""

    def run(texts: pa.Array) -> pa.Array:
        return in_slices(texts, lambda part: of(part, automaton_of(lexicon)))

    def of(texts: pa.Array, a: ahocorasick.Automaton) -> pa.Array:
        f = [features(t, a) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([probability(x, y, lexicon.curve) for x, y, _ in f], pa.float64()), pa.array([n for *_, n in f], pa.int64())], ["score", "n_matches"])

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    small_batches()
    return F.arrow_udf(run, "struct<score: double, n_matches: bigint>")(text)


def held_out_fold(key: Column) -> Column:
    return fold_remainder(key, 3) == 1


def scores(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, score, predicted class and number of matches."""
    s = docs.select(F.col(id_col), score_column(F.col(text_col), lexicon).alias("_s"))
    return s.select(id_col, F.col("_s.score").alias("score"), (F.col("_s.score") >= LIMIT).cast("int").alias("predicted"), F.col("_s.n_matches").alias("n_matches"))


def clean(docs: DataFrame, lexicon: Lexicon, text_col: str = "text") -> DataFrame:
    """The rows whose score is below the limit."""
    return docs.where(score_column(F.col(text_col), lexicon)["score"] < LIMIT)
