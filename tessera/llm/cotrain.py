"""Quality classifier by co-training (operator 8).

Two views of a document. The text view has its content: byte trigrams hashed to ``N_GRAMS`` numbers,
length of words, symbols and repetition. The metadata view has what a record of the page tells without
its words: language, source, stated length, and its layout (number of lines, their length in bins,
the longest one). All features are shares between 0 and 1 in steps of 1 / 255; a table of them is made
once, by the workers.

A logistic classifier per view starts from labelled rows, and is calibrated on others that neither
view learns from. In each round each view scores every unlabelled document, and hands the different
texts it is surest of to the other view: those of a calibrated probability of at least ``SURE``, at most
``handed`` and no more than a share of the labelled rows, and of each label as many as keeps the
proportion of the labelled rows. So a view that cannot tell a label hands over nothing. They are
picked from the whole corpus: a task keeps its surest texts, and Spark takes the surest of these. At the
end a last logistic curve over both calibrated views combines them, and every document is scored.

Fitting uses at most about ``max_rows`` labelled rows, picked by a hash of the id, and ``handed`` rows
a round and view: bounds that don't grow with the corpus, so that the fit fits the driver.

Defined cases. A null or empty text has the features of an empty one; null metadata is a value of
its own. Labels other than 0 and 1 are left out; of several labels of an id the greatest counts, of
several texts of an id the one of least hash is learned from. Texts equal to a labelled one of the
sample are handed over like others. Of texts of which a view is equally sure (to four digits) those of least
hash come first. Without labelled rows of both kinds all scores are the share of label 1 (or one half). Null
ids are scored like others and never are labelled. An empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import fold_remainder, map_batches, slices, stored
from tessera.llm.quality import base_features

MAX_ROWS = 10_000
ROUNDS = 4
#: Texts that a view hands over in a round at most, also as a share of the labelled ones; how sure it has to be.
HANDED, HANDED_SHARE, SURE = 500, 0.1, 0.95
#: Hashed trigrams, sources, languages, and bins of the length of a line (powers of the root of two).
N_GRAMS, SOURCES, LANGS, BINS = 512, 64, 16, 32
N_TEXT, N_META = N_GRAMS + 6, SOURCES + LANGS + BINS + 5
FOLDS, HELD_OUT, CALIBRATION = 5, 3, 1


def log_share(n: float) -> float:
    """A number from 0 on as a share: 1 from 2 ** 24 on."""
    return min(1.0, float(np.log2(1 + n)) / 24)


def text_view(text: str | None) -> np.ndarray:
    """Features of a text: square roots of the shares of hashed trigrams, words, symbols, repetition."""
    raw = np.frombuffer((text or "").encode(), np.uint8).astype(np.uint32)
    n_words, n_chars, n_symbols, n_dup, n_repeat = base_features(text)
    grams = (raw[:-2] * np.uint32(0x9E3779B1) ^ raw[1:-1] * np.uint32(0x85EBCA6B) ^ raw[2:] * np.uint32(0xC2B2AE35)) * np.uint32(0x27D4EB2F) >> np.uint32(23)
    shares = np.sqrt(np.bincount(grams, minlength=N_GRAMS) / max(1, len(grams)))
    more = [log_share(n_words), log_share(n_chars / max(1, n_words)), n_symbols / max(1, n_chars), n_dup / ((text or "").count("\n") + 1), n_repeat / max(1, n_words), min(1.0, n_words / 200)]
    return np.concatenate([shares, more])


def meta_view(lang: str | None, source: str | None, n_chars: int | None, text: str | None) -> np.ndarray:
    """Features of the metadata: hashed source and language, stated length, layout of the lines."""
    out = np.zeros(N_META)
    out[xxhash.xxh32_intdigest(f"{source is None}{source}") % SOURCES] = 1
    out[SOURCES + xxhash.xxh32_intdigest(f"{lang is None}{lang}") % LANGS] = 1
    sizes = np.array([len(x) for x in (text or "").split("\n")])
    bins = np.minimum(2 * np.log2(1 + sizes), BINS - 1).astype(np.int64)
    out[SOURCES + LANGS : SOURCES + LANGS + BINS] = np.bincount(bins, minlength=BINS) / len(sizes)
    out[-5:] = n_chars is None, log_share(max(0, n_chars or 0)), log_share(len(sizes)), log_share(sizes.max()), log_share(sizes.mean())
    return out


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``sha`` (a hash of the text) and ``x`` (both views, a byte a feature) of every row, in a table."""

    def run(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        for part in slices(batch.column(4)):
            rows = batch.slice(part.start, part.stop - part.start)
            views = (np.concatenate([text_view(t), meta_view(lang, source, n, t)]) for lang, source, n, t in zip(*(rows.column(k).to_pylist() for k in range(1, 5)), strict=True))
            x = [np.rint(255 * v).astype(np.uint8).tobytes() for v in views]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(5), pa.array(x, pa.binary())], ["id", "sha", "x"])

    have = {c.lower() for c in docs.columns}
    other = [(F.col(c).cast(kind) if c in have else F.lit(None).cast(kind)).alias(c) for c, kind in (("lang", "string"), ("source", "string"), ("n_chars", "long"))]
    src = docs.select(F.col(id_col).alias("id"), *other, F.col(text_col).cast("string").alias("text"))
    src = src.withColumn("sha", F.xxhash64(F.coalesce("text", F.lit(""))))
    return stored(map_batches(src, run, f"id {dict(src.dtypes)['id']}, sha long, x binary"), "features")


def split(x: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Both views of a column of features."""
    rows = np.frombuffer(b"".join(x.to_pylist()), np.uint8).reshape(-1, N_TEXT + N_META).astype(np.float64) / 255
    return rows[:, :N_TEXT], rows[:, N_TEXT:]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Linear:
    """A logistic classifier over scaled features."""

    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray

    def logit(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale @ self.w[1:] + self.w[0]


def fit_linear(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> Linear:
    """Newton steps for the ridge-penalised logistic likelihood."""
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale > 1e-6, scale, 1.0)
    m = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    penalty = np.full(m.shape[1], ridge)
    penalty[0] = 1e-6
    w = np.zeros(m.shape[1])
    for _ in range(steps):
        p = sigmoid(m @ w)
        step = np.linalg.solve((m * (p * (1 - p) + 1e-9)[:, None]).T @ m + np.diag(penalty), m.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return Linear(mean, scale, w)


@dataclass
class CoTrained:
    text: Linear | None
    meta: Linear | None
    text_curve: Linear | None
    meta_curve: Linear | None
    both: Linear | None
    share: float

    def scores(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Combined, text and metadata probabilities of label 1."""
        if self.text is None:
            same = np.full(len(a), self.share)
            return same, same, same
        t = self.text_curve.logit(self.text.logit(a)[:, None])
        m = self.meta_curve.logit(self.meta.logit(b)[:, None])
        return sigmoid(self.both.logit(np.column_stack([t, m]))), sigmoid(t), sigmoid(m)


@dataclass
class Lessons:
    """The rows that each view learns from: its own features, labels, and the texts it has been handed."""

    x: list[np.ndarray]
    y: list[np.ndarray]
    given: list[set[int]] = field(default_factory=lambda: [set(), set()])

    def models(self) -> list[Linear]:
        return [fit_linear(x, y) for x, y in zip(self.x, self.y, strict=True)]

    def hand(self, taker: int, x: np.ndarray, y: np.ndarray, shas: list[int]) -> None:
        self.x[taker] = np.concatenate([self.x[taker], x])
        self.y[taker] = np.concatenate([self.y[taker], y])
        self.given[taker].update(shas)


def surest(pool: DataFrame, models: list[Linear], curves: list[Linear], given: list[set[int]], handed: int, share: float) -> list[list[tuple[int, int]]]:
    """Per taking view: (``sha``, label) of the different texts of which the other view is surest."""
    parts = [max(1, round(handed * (1 - share))), max(1, round(handed * share))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            sha = batch.column(0).to_numpy()
            views = split(batch.column(1))
            for giver in (0, 1):
                p = np.round(sigmoid(curves[giver].logit(models[giver].logit(views[giver])[:, None])), 4)
                open_ = ~np.isin(sha, list(given[1 - giver]))
                for label, sure in ((1, p), (0, 1 - p)):
                    who = np.flatnonzero(open_ & (sure >= SURE))
                    was = best.get((1 - giver, label), (np.empty(0, np.int64), np.empty(0)))
                    names, first = np.unique(np.concatenate([was[0], sha[who]]), return_index=True)
                    values = np.concatenate([was[1], sure[who]])[first]
                    top = np.lexsort((names, -values))[: parts[label]]
                    best[1 - giver, label] = names[top], values[top]
        for (taker, label), (names, values) in best.items():
            n = len(names)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, taker, np.int32)), pa.array(np.full(n, label, np.int32)), pa.array(names), pa.array(values)], ["taker", "label", "sha", "sure"])

    found = stored(pool.select("sha", "x").mapInArrow(run, "taker int, label int, sha long, sure double").groupBy("taker", "label", "sha").agg(F.max("sure").alias("sure")), "surest")
    out: list[list[tuple[int, int]]] = [[], []]
    for taker in (0, 1):
        # Bounded by handed.
        best = [[r["sha"] for r in found.where((F.col("taker") == taker) & (F.col("label") == label)).orderBy(F.desc("sure"), "sha").limit(parts[label]).collect()] for label in (0, 1)]
        part = min(len(x) / n for x, n in zip(best, parts, strict=True))
        out[taker] = [(sha, label) for label in (0, 1) for sha in best[label][: int(part * parts[label])]]
    return out


def rows_of(pool: DataFrame, shas: set[int]) -> dict[int, np.ndarray]:
    """The features of some texts (bounded by what is handed over), by hash; rows of one hash have
    different metadata: the least counts."""
    if not shas:
        return {}
    picked = F.broadcast(pool.sparkSession.createDataFrame([(s,) for s in sorted(shas)], "sha long"))
    return {r["sha"]: np.frombuffer(r["x"], np.uint8) / 255 for r in pool.join(picked, "sha").groupBy("sha").agg(F.min("x").alias("x")).collect()}


def fit(table: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, rounds: int = ROUNDS, handed: int = HANDED) -> CoTrained:
    """Fits on labelled rows outside the held-out fold, and what the views tell each other about all
    other rows of ``table`` (of ``features``)."""
    named = labels.where("doc_id is not null").select(F.col("doc_id").alias("_key"), F.col("quality").alias("_y"))
    known = named.where(F.col("_y").isin(0, 1)).groupBy("_key").agg(F.max("_y").alias("_y"))
    known = known.where(fold_remainder(F.col("_key"), FOLDS) != HELD_OUT)
    share = min(1.0, max_rows / max(1, known.count()))
    known = F.broadcast(known.where(F.pmod(F.xxhash64("_key", F.lit(8)), F.lit(1_000_000)) < int(share * 1_000_000)))  # about max_rows rows of 12 bytes at most
    one = F.min(F.struct("sha", "x")).alias("one")
    rows = table.join(known, F.col("id") == F.col("_key")).groupBy("id", "_y").agg(one).select("id", "_y", "one.x").orderBy("id").toArrow()  # bounded by max_rows
    y = rows.column("_y").to_numpy().astype(np.int64)
    aside = np.array([zlib.crc32(str(i).encode()) % FOLDS == CALIBRATION for i in rows.column("id").to_pylist()], bool)
    labelled = ~aside
    if not all(0 < y[s].sum() < s.sum() for s in (labelled, aside)):
        return CoTrained(None, None, None, None, None, float(y.mean()) if len(y) else 0.5)
    both = split(rows.column("x").combine_chunks())
    share = float(y[labelled].mean())
    lessons = Lessons([v[labelled] for v in both], [y[labelled], y[labelled]])
    pool = table.where("id is null").unionByName(table.join(named.select(F.col("_key").alias("id")).distinct(), "id", "left_anti").where("id is not null"))
    if rounds:
        pool = stored(pool.select("sha", "x"), "pool")
    handed = min(handed, max(2, int(HANDED_SHARE * labelled.sum())))

    def calibrated(models: list[Linear]) -> list[Linear]:
        return [fit_linear(m.logit(v[aside])[:, None], y[aside]) for m, v in zip(models, both, strict=True)]

    for _ in range(rounds):
        models = lessons.models()
        picked = surest(pool, models, calibrated(models), lessons.given, handed, share)
        x = rows_of(pool, {s for part in picked for s, _ in part})
        for taker, part in enumerate(picked):
            if part:
                views = np.array([x[s] for s, _ in part])
                lessons.hand(taker, views[:, :N_TEXT] if taker == 0 else views[:, N_TEXT:], np.array([label for _, label in part]), [s for s, _ in part])
    models = lessons.models()
    curves = calibrated(models)
    z = np.column_stack([c.logit(m.logit(v[aside])[:, None]) for c, m, v in zip(curves, models, both, strict=True)])
    return CoTrained(*models, *curves, fit_linear(z, y[aside]), share)


def held_out_fold(key: Column) -> Column:
    return fold_remainder(key, FOLDS) == HELD_OUT


def scores(table: DataFrame, model: CoTrained, id_col: str = "doc_id") -> DataFrame:
    """Per row of ``features``: id, combined score of label 1, predicted label, and the scores of both views."""

    def run(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        s, t, m = model.scores(*split(batch.column(1)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array(t), pa.array(m)], ["id", "score", "predicted", "text_score", "meta_score"])

    kind = dict(table.dtypes)["id"]
    return map_batches(table.select("id", "x"), run, f"id {kind}, score double, predicted int, text_score double, meta_score double").withColumnRenamed("id", id_col)
