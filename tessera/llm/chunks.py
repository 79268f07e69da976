"""Substring deduplication by content-defined chunks (operator 1).

A gear hash rolls over the bytes of a text: h = 2h + gear[byte] in 32 bits, so it depends on the
last 16 bytes only. A chunk ends behind a blank (or tab or line end) where the top bits of h are
zero, not before ``MIN_BYTES`` and at the latest after ``MAX_BYTES``. Where no blank has come
for ``FAR`` bytes (Chinese, Japanese, Thai, encoded blobs) it ends behind any character with more
such zero bits. An insertion moves the ends near it; behind, the same ends are found again. Chunks
are compared by a 128-bit digest. All occurrences but the first (least id, then hash of the text,
then place) are repeats; they are cut out where they form a run of at least ``min_run`` bytes, so
that single short chunks which meet by chance stay. A repeated passage loses to its surroundings
what lies before its first common end and behind its last one: some 45 bytes of a passage of 51 words.

There is one shuffle of chunks. A worker sorts a few megabytes of text at a time by digest: of each
digest only the first occurrence there goes on under it, as the others are known for repeats, so
that a very frequent chunk is one row per slice. A window over each digest finds the first of all.
What repeats is collected per text, never per digest, and joined into runs; texts are not cut into
chunks again.

Defined cases. A null text counts as empty and comes back as null; an empty text has no chunks.
A null id comes after all others. Rows with equal id and text are one text: they repeat other
texts but not each other. An empty table gives an empty result. Other columns are kept by
``deduplicated`` whatever their names; if a column ``n_chars`` is named it follows the new text.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import map_batches, slices, stored

#: Of the hash, in bytes; not more than MIN_BYTES.
WINDOW = 16
MIN_BYTES, MAX_BYTES = 16, 256
#: Zero bits asked for behind a blank: one blank in two ends a chunk.
ZERO_BITS = 1
#: Bytes without a blank behind which any character may end a chunk, and the zero bits asked for there.
FAR, FAR_BITS = 64, 4
#: A span is one number: its first byte times this, and its size.
SPAN = 1 << 12
#: Texts with repeats, and spans of theirs, that are broadcast at most (some 30 MB); more go
#: through a shuffle with the texts.
BROADCAST_TEXTS, BROADCAST_SPANS = 200_000, 1_000_000
#: Bytes of adjacent repeated chunks that are cut out; less may repeat by chance.
MIN_RUN = 64


def gear(seed: int = 1) -> np.ndarray:
    """One random 32-bit number per byte, from the digest of the byte."""
    return np.array([xxhash.xxh32_intdigest(bytes([b]), seed) for b in range(256)], np.uint32)


GEAR = gear()
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True


def rolling(data: np.ndarray) -> np.ndarray:
    """The gear hash behind each byte: window sums of 1, 2, 4, ... 16 bytes."""
    h = GEAR[data]
    width = 1
    while width < WINDOW:
        low = h[:-width].copy() if len(h) > width else h[:0]
        h[width:] += low << np.uint32(width)
        width *= 2
    return h


def ends_of(data: np.ndarray, begins: np.ndarray, stops: np.ndarray) -> list[list[int]]:
    """Chunk ends of each text in a buffer; a text lies at ``begins[i] : stops[i]``.

    As no chunk ends within its first 16 bytes, no end depends on bytes before its chunk.
    """
    h = rolling(data)
    blank = BLANK[data]
    cuts = np.flatnonzero(blank & ((h >> np.uint32(32 - ZERO_BITS)) == 0)) + 1
    far = np.flatnonzero((h[:-1] >> np.uint32(32 - FAR_BITS) == 0) & (data[1:] & 0xC0 != 0x80)) + 1
    # Bytes since the last blank, or since the text began.
    since = np.sort(np.concatenate([np.flatnonzero(blank) + 1, begins]))
    far = far[far - np.append(since, 0)[np.searchsorted(since, far, "right") - 1] >= FAR]
    cuts = np.sort(np.concatenate([cuts, far]))
    out = []
    first, last = np.searchsorted(cuts, begins, "left").tolist(), np.searchsorted(cuts, stops, "right").tolist()
    for a, z, i, j in zip(begins.tolist(), stops.tolist(), first, last, strict=True):
        ends, at = [], a
        for cut in cuts[i:j].tolist():
            if cut - at < MIN_BYTES:
                continue
            while cut - at > MAX_BYTES:
                at = whole(data, at + MAX_BYTES, z)
                ends.append(at)
            if cut - at >= MIN_BYTES:
                at = cut
                ends.append(at)
        while z - at > MAX_BYTES:
            at = whole(data, at + MAX_BYTES, z)
            ends.append(at)
        if at < z:
            ends.append(z)
        out.append(ends)
    return out


def whole(data: np.ndarray, at: int, stop: int) -> int:
    """The next place at or after ``at`` where a character begins."""
    while at < stop and data[at] & 0xC0 == 0x80:
        at += 1
    return at


def buffer_of(text: pa.Array) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The bytes of a column of texts, and where each text begins and stops (null: empty)."""
    parts = [b"" if t is None else t.encode() for t in text.to_pylist()]
    stops = np.cumsum([len(p) for p in parts], dtype=np.int64)
    return b"".join(parts), stops - np.array([len(p) for p in parts], np.int64), stops


def digests_of(raw: bytes, every: list[list[int]], begins: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Two halves of the digest of every chunk, one after the other, and its span within its text."""
    n = sum(map(len, every))
    digest, out, k, spans = xxhash.xxh3_128_digest, bytearray(16 * n), 0, np.empty(n, np.int64)
    for at, ends in zip(begins, every, strict=True):
        edge = np.array([at, *ends], np.int64)
        spans[k : k + len(ends)] = (edge[:-1] - at) * SPAN + np.diff(edge)
        for end in ends:
            out[16 * k : 16 * k + 16] = digest(raw[at:end])
            at, k = end, k + 1
    return np.frombuffer(bytes(out), ">i8").reshape(-1, 2).astype(np.int64), spans


def chunks(keyed: DataFrame) -> DataFrame:
    """``hi``, ``lo`` (the digest), ``id``, ``sha``, ``span`` of the chunks of (``id``, ``sha``, ``text``).

    Of the chunks of one digest in a slice only the first goes under its digest. The others are
    repeats already: they have a negative span, and go under their own text and place.
    """

    def run(whole_batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        for part in slices(whole_batch.column(2)):
            yield from of_slice(whole_batch.slice(part.start, part.stop - part.start))

    def of_slice(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        raw, begins, stops = buffer_of(batch.column(2))
        every = ends_of(np.frombuffer(raw, np.uint8), begins, stops)
        if not raw:
            return
        halves, spans = digests_of(raw, every, begins.tolist())
        owner = np.repeat(np.arange(len(every)), [len(e) for e in every])
        ids, shas = (batch.column(k).to_numpy() for k in (0, 1))
        rows = np.stack([halves[:, 0], halves[:, 1], ids[owner], shas[owner], spans])
        rows = rows[:, np.argsort(rows[0], kind="stable")]
        same = rows[0, 1:] == rows[0, :-1]
        several = np.append(same, False) | np.append(False, same)
        some = rows[:, several]
        some = some[:, np.lexsort(some[::-1])]
        new = np.append(True, (some[:2, 1:] != some[:2, :-1]).any(axis=0))[: some.shape[1]]
        first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        # Equal rows of the table are one text, no repeats of each other.
        later = some[:, (some[2:] != some[2:, first]).any(axis=0)]
        later[0], later[1], later[4] = later[3], later[2] ^ later[4], -later[4]
        rows = np.concatenate([rows[:, ~several], some[:, new], later], axis=1)
        for i in range(0, rows.shape[1], 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in rows[:, i : i + (1 << 16)]], ["hi", "lo", "id", "sha", "span"])

    return map_batches(keyed.select("id", "sha", "text"), run, "hi long, lo long, id long, sha long, span long")


def keyed_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)).alias("id"), F.xxhash64(text).alias("sha"), text.alias("text"))


def merged(spans: list[int] | None, least: int) -> list[dict[str, int]]:
    """Runs of adjacent chunks, of at least so many bytes."""
    runs: list[list[int]] = []
    for begin, size in sorted(divmod(x, SPAN) for x in spans or ()):
        if runs and runs[-1][1] == begin:
            runs[-1][1] += size
        else:
            runs.append([begin, begin + size])
    return [{"b": b, "e": e} for b, e in runs if e - b >= least]


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_run: int = MIN_RUN) -> DataFrame:
    """``id``, ``sha``, ``spans``: the runs of ``min_run`` bytes and more of each text that occur earlier."""

    # Not a function of a column: Spark would call it once for its value and once for the filter on it,
    # each time in a Python worker of its own.
    def runs(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        found = [merged(x, min_run) for x in batch.column(2).to_pylist()]
        some = pa.array([bool(x) for x in found], pa.bool_())
        kind = pa.list_(pa.struct([("b", pa.int64()), ("e", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, kind)], ["id", "sha", "spans"]).filter(some)

    own = ["id", "sha", "span"]
    first = Window.partitionBy("hi", "lo").orderBy(*own)
    every = chunks(keyed_texts(docs, id_col, text_col)).select(*own, *[F.first(c).over(first).alias(f"first_{c}") for c in own])
    earlier = (F.col("id") != F.col("first_id")) | (F.col("sha") != F.col("first_sha")) | (F.col("span") != F.col("first_span"))
    again = every.where((F.col("span") < 0) | earlier).groupBy("id", "sha").agg(F.collect_set(F.abs("span")).alias("spans"))
    return stored(map_batches(again, runs, "id long, sha long, spans array<struct<b: bigint, e: bigint>>"), "repeats")


def cut_out(text: pa.Array, spans: pa.Array) -> pa.Array:
    """The texts without the given spans of bytes."""
    out = []
    for t, cuts in zip(text.to_pylist(), spans.to_pylist(), strict=True):
        if t is not None and cuts:
            raw = t.encode()
            t = b"".join(raw[a:z] for a, z in zip([0, *(c["e"] for c in cuts)], [*(c["b"] for c in cuts), len(raw)], strict=True)).decode()
        out.append(t)
    return pa.array(out, pa.string())


def joined(docs: DataFrame, id_col: str, text_col: str, min_run: int) -> tuple[DataFrame, Column]:
    """All rows of ``docs`` as ``d``, with the spans of their repeats as ``r``; and the texts that stay."""
    found = repeats(docs, id_col, text_col, min_run)
    size = found.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("spans")), F.lit(0)).alias("spans")).first()
    small = size["n"] <= BROADCAST_TEXTS and size["spans"] <= BROADCAST_SPANS
    found = (F.broadcast(found) if small else found).alias("r")
    key = F.coalesce(F.col(f"d.{id_col}").cast("long"), F.lit(2**63 - 1))
    text = F.coalesce(F.col(f"d.{text_col}"), F.lit(""))
    rows = docs.alias("d").join(found, (key == F.col("r.id")) & (F.xxhash64(text) == F.col("r.sha")), "left")
    return rows, F.arrow_udf(cut_out, "string")(F.col(f"d.{text_col}"), F.col("r.spans"))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_run: int = MIN_RUN) -> DataFrame:
    """Per row: bytes before, bytes and spans cut out, and the text that stays."""
    rows, new = joined(docs, id_col, text_col, min_run)
    spans = F.coalesce("r.spans", F.array().cast("array<struct<b: bigint, e: bigint>>"))
    removed = F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s["e"] - s["b"])
    n_bytes = F.octet_length(F.coalesce(F.col(f"d.{text_col}"), F.lit(""))).cast("long")
    return rows.select(F.col(f"d.{id_col}").alias(id_col), n_bytes.alias("n_bytes"), removed.alias("removed_bytes"), spans.alias("spans"), new.alias("text"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = None, min_run: int = MIN_RUN) -> DataFrame:
    """All rows and columns; repeated passages are cut out of the text."""
    rows, new = joined(docs, id_col, text_col, min_run)

    def column(c: str) -> Column:
        if c == text_col:
            return new.alias(c)
        return F.coalesce(F.length(new), F.col(f"d.{c}")).cast(docs.schema[c].dataType).alias(c) if c == chars_col else F.col(f"d.`{c}`")

    return rows.select(*[column(c) for c in docs.columns])
