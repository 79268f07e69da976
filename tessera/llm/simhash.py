"""SimHash near-duplicate detection (operator 4).

Fingerprints. Words are lower-cased (A to Z), shingles of ``k`` words are joined by one blank,
repeats included; a text with fewer words is one shingle, one without words has fingerprint zero.
Bit b is set if it is set in more than half of the shingles' XXH64 (seed 42).

Links. Only distinct fingerprints are compared, so a group of copies counts once. A pivot distance
table holds the Hamming distance of each fingerprint to many reference fingerprints; by the triangle
inequality a pair whose coordinates differ by more than r anywhere is no link. What is not discarded
is verified. Pivots alone are no key to join by; so that not all fingerprints have to be in one place,
they are dealt to buckets: two with at most r differing bits agree in one of r + 1 blocks of bits. In
small buckets all pairs are looked at, in larger ones groups are grown: what is linked to a member
leaves the rest that the next is held against, so a bucket of near copies takes few steps. A
bucket gives no pairs but a spanning star of each group of linked fingerprints.

A bucket of more than ``bucket_limit`` fingerprints, which should not be one task's, is cut again: of
its other bits, r + 1 blocks are formed and again one of them must agree. If so many are still together
when chance would have spread them, they are a cluster of near copies. These are linked through
numbers: two of them are within r bits if and only if some number is within r // 2 bits of one and
r - r // 2 of the other, so each is written under all such numbers, and linked to the least
fingerprint that is within r // 2 of the number.

Near copies by similarity (``near_classes``, ``one_per_near_class``) are texts whose shingles of
``k`` words, each counted as often as it occurs, have a Jaccard similarity of ``threshold`` or more.
Their fingerprints differ in up to some 20 bits, where blocks of bits are too short to be a key. So they are brought together by minima of hashes over the
shingles: ``BAND_ROWS`` minima name a bucket, each text is in ``BANDS`` buckets, and a pair of
similarity s misses all with a chance of (1 - s ** BAND_ROWS) ** BANDS. Buckets of the same texts
count once. In a bucket, a pivot distance table discards pairs that cannot be within ``NEAR_RADIUS`` bits
of SimHash; at this radius only pivots near the texts tell them apart, so they are members of the bucket,
each the farthest from those before it. What is left is verified by its SimHash and then by its shingles; a text that is linked is not compared again, and only links are written. Texts of the same
words are one text from the start, so a group of copies counts once; so do texts without words.

Components. The stars are joined by repeated minimum over neighbours and pointer jumping, with a
table in the shared folder after each round. Nothing is collected to the driver.

Defined cases. A null text counts as empty. The class id is the smallest id; a null id never is
one unless the whole class has null ids. Repeated rows belong to one class. An empty table gives
an empty result. Other columns are ignored here and kept by ``one_per_class``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import forget, map_slices, stored

SEED = 42
#: Fingerprints of a bucket whose pairs are all looked at, and that one task works off.
ALL_PAIRS, BUCKET_LIMIT = 1024, 1 << 16
N_PIVOTS = 32
#: Pairs that are looked at together.
PAIRS = 1 << 20
#: For similarity 0.8 the bands miss 3 pairs in a million; the radius is five deviations off.
BANDS, BAND_ROWS, NEAR_RADIUS = 24, 4, 24
#: Members of a bucket of near copies that are pivots.
NEAR_PIVOTS = 8
#: Rows (of an id and a hash) that are broadcast at most; more go through a shuffle with the texts.
BROADCAST_ROWS = 1_000_000


def pivots(n: int = N_PIVOTS) -> np.ndarray:
    """Reference fingerprints: the first n outputs of the SplitMix64 generator."""
    out, x, all_ones = [], 0, (1 << 64) - 1
    for _ in range(n):
        x = (x + 0x9E3779B97F4A7C15) & all_ones
        z = x
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & all_ones
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & all_ones
        out.append(z ^ (z >> 31))
    return np.array(out, np.uint64)


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """XXH64 of every shingle of a text."""
    w = (text or "").encode().lower().split()
    if not w:
        return np.empty(0, np.uint64)
    line = b" ".join(w)
    if len(w) <= k:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    ends = np.cumsum([len(x) + 1 for x in w])
    begins = [0, *ends.tolist()]
    digest, n = xxhash.xxh64_intdigest, len(w) - k + 1
    return np.fromiter((digest(line[a : b - 1], SEED) for a, b in zip(begins, begins[k:], strict=False)), np.uint64, n)


def fingerprint(hashes: np.ndarray) -> int:
    """The majority of each bit; zero for no hashes."""
    votes = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        part = np.unpackbits(hashes[i : i + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += part.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0])


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``text`` and ``sha`` (a hash of the text) of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("sha"))


def fingerprints(docs: DataFrame, k: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``fp`` (the 64 bits as a signed long) and ``sha`` (a hash of the text) of every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(shingle_hashes(t, k)) for t in batch.column(1).to_pylist()], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64)), batch.column(2)], ["id", "fp", "sha"])

    return map_slices(keyed(docs, id_col, text_col), 1, run, "id long, fp long, sha long")


def cut_bits(mask: int, parts: int) -> list[int]:
    """Masks of ``parts`` runs that together are the bits of ``mask``."""
    bits = [b for b in range(64) if mask >> b & 1]
    edge = [len(bits) * i // parts for i in range(parts + 1)]
    return [sum(1 << b for b in bits[a:z]) for a, z in zip(edge, edge[1:], strict=False)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def verified(fp: np.ndarray, bucket_end: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within a bucket that differ in at most ``radius`` bits.

    Rows of a bucket are adjacent; ``bucket_end[i]`` is where the bucket of row i ends.
    """
    table = np.bitwise_count(fp[:, None] ^ pivots()[None, :]).astype(np.int8)
    n = len(fp)
    partners = bucket_end - np.arange(n) - 1
    before = np.concatenate([[0], np.cumsum(partners)])
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(before, before[at] + PAIRS, "right")) - 1)
        m = partners[at:to]
        a = np.repeat(np.arange(at, to), m)
        b = a + 1 + np.arange(len(a)) - np.repeat(before[at:to] - before[at], m)
        for p in range(table.shape[1]):
            if not len(a):
                break
            near = np.abs(table[a, p] - table[b, p]) <= radius
            a, b = a[near], b[near]
        near = np.bitwise_count(fp[a] ^ fp[b]) <= radius
        if near.any():
            yield a[near], b[near]
        at = to


def stars(fp: np.ndarray, bucket_end: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Per group of linked rows of a bucket: every other row with the first one."""
    label = np.arange(len(fp))
    for a, b in verified(fp, bucket_end, radius):
        while True:
            low = np.minimum(label[a], label[b])
            if (label[a] == low).all() and (label[b] == low).all():
                break
            # Roots only: another label of a row would cut it off from those it was linked to before.
            u, v = label[a], label[b]
            np.minimum.at(label, u, low)
            np.minimum.at(label, v, low)
            while (label != label[label]).any():
                label = label[label]
    while (label != label[label]).any():
        label = label[label]
    others = np.flatnonzero(label != np.arange(len(fp)))
    return fp[others], fp[label[others]]


def grown(fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for one large bucket: groups are grown from one member after the other."""
    table = np.ascontiguousarray(np.bitwise_count(fp[None, :] ^ pivots()[:, None]).astype(np.int8))
    left = np.arange(len(fp))
    label = np.arange(len(fp))
    while len(left):
        root, left = left[0], left[1:]
        todo = [root]
        while todo and len(left):
            a = todo.pop()
            near = left
            for row in table:
                near = near[np.abs(row[near] - row[a]) <= radius]
                if len(near) < 64:
                    break
            near = near[np.bitwise_count(fp[near] ^ fp[a]) <= radius]
            if len(near):
                label[near] = root
                left = left[label[left] != root]
                todo += near.tolist()
    others = np.flatnonzero(label != np.arange(len(fp)))
    return fp[others], fp[label[others]]


def bucket_links(fp: np.ndarray, ends: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within buckets that lie one after the other; ``ends`` is where each ends."""
    sizes = np.diff(ends, prepend=0)
    small = np.repeat(sizes <= ALL_PAIRS, sizes)
    own = sizes[sizes <= ALL_PAIRS]
    out = [stars(fp[small], np.repeat(np.cumsum(own), own), radius)]
    out += [grown(fp[e - n : e], radius) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True) if n > ALL_PAIRS]
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def links(distinct: DataFrame, radius: int = 4, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """``u``, ``v``: pairs of fingerprints that connect all fingerprints linked within the radius.

    ``distinct`` holds each fingerprint once, in column ``fp``.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((3, 0), np.int64)

        def close(rows: np.ndarray) -> pa.RecordBatch:
            new = np.flatnonzero((rows[:2, 1:] != rows[:2, :-1]).any(axis=0)) + 1
            ends = np.concatenate([new, [rows.shape[1]]])
            u, v = bucket_links(rows[2].view(np.uint64), ends, radius)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

        for batch in batches:
            rows = np.concatenate([held, np.stack([c.to_numpy() for c in batch.columns])], axis=1)
            if not rows.shape[1]:
                continue
            last = (rows[:2] != rows[:2, -1:]).any(axis=0)
            cut = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
            held = np.ascontiguousarray(rows[:, cut:])
            if cut:
                yield close(np.ascontiguousarray(rows[:, :cut]))
        if held.shape[1]:
            yield close(held)

    def bucketed(rows: DataFrame) -> DataFrame:
        return rows.repartition("mask", "val").sortWithinPartitions("mask", "val").mapInArrow(run, "u long, v long")

    every = (1 << 64) - 1
    total = distinct.count()
    known, found = {0: None}, None
    items = distinct.select("fp", F.lit(0).cast("long").alias("mask"))
    while True:
        finer = {signed(m): [signed(m & every | c) for c in cut_bits(every & ~m, radius + 1)] for m in known}
        cuts = F.create_map(*[x for m, cs in finer.items() for x in (F.lit(m), F.array(*map(F.lit, cs)))])
        items = items.select("fp", F.explode_outer(cuts[F.col("mask")]).alias("mask")).select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("val"), "fp")
        heavy = stored(items.groupBy("mask", "val").count().where(F.col("count") > bucket_limit).select("mask", "val"), "heavy")
        known = {m[0] & every: None for m in heavy.select("mask").distinct().collect()}  # at most (radius + 1) ** level values
        light = bucketed(items.join(heavy, ["mask", "val"], "left_anti") if known else items)
        found = light if found is None else found.union(light)
        if not known:
            return found
        items = items.join(heavy, ["mask", "val"], "left_semi")
        fixed = min(m.bit_count() for m in known)
        if total / 2**fixed <= bucket_limit / 4 or 64 - fixed <= radius:
            return found.union(dense_links(items.select("fp").distinct(), radius))
        items = items.select("fp", "mask")


def dense_links(members: DataFrame, radius: int) -> DataFrame:
    """``u``, ``v``: links among fingerprints many of which are near each other."""

    def within(r: int) -> DataFrame:
        flips = [sum(1 << b for b in bits) for n in range(r + 1) for bits in combinations(range(64), n)]
        return members.select("fp", F.explode(F.array(*[F.lit(signed(x)) for x in flips])).alias("x")).select("fp", F.col("fp").bitwiseXOR(F.col("x")).alias("z"))

    least = within(radius // 2).groupBy("z").agg(F.min("fp").alias("v"))
    return within(radius - radius // 2).join(least, "z").where("fp != v").select(F.col("fp").alias("u"), "v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``label``: for every end of the edges (``u``, ``v``), the least node of its component."""
    both = stored(edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = stored(both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("u"), F.min("v")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), F.col("label").alias("near")), "v").groupBy("u").agg(F.min("near").alias("near"))
        low = labels.join(near, F.col("node") == F.col("u")).select("node", "label", F.least("label", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("far"))
        after = stored(low.join(jump, "low").select("node", F.least("low", "far").alias("label"), (F.least("low", "far") != F.col("label")).alias("moved")), "labels")
        done = after.where("moved").isEmpty()
        forget(labels)
        labels = after
        if done:
            return labels.select("node", "label")


def classes(docs: DataFrame, k: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text", bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """``id``, ``fp``, ``sha``, ``component_id`` and ``label`` (which tells classes without ids apart) of every row."""
    fps = stored(fingerprints(docs, k, id_col, text_col), "fingerprints")
    distinct = stored(fps.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    found = components(links(distinct.select("fp"), radius, bucket_limit))
    named = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    of = stored(named.join(least, "label").select("fp", "label", "component_id"), "classes")
    return fps.join(of, "fp").select("id", "fp", "sha", "component_id", "label")


def one_per_class(docs: DataFrame, k: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each class the one with the least id, and of rows that
    share this id the one with the least hash of the text; of equal rows, one. Classes of one least id
    count as one; each class that has only null ids keeps a row."""
    rows = classes(docs, k, radius, id_col, text_col)
    return staying(docs, rows.withColumn("label", F.when(F.col("component_id").isNull(), F.col("label"))), ["component_id", "label"], id_col, text_col)


def staying(docs: DataFrame, rows: DataFrame, group: list[str], id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` with the least id and hash of the text of each group of ``rows``, each once."""
    first = F.min(F.struct(F.col("id").isNull().alias("no"), "id", "sha")).alias("r")
    keep = stored(rows.groupBy(*group).agg(first).select("r.id", "r.sha").distinct(), "keep")
    each = rows.groupBy("id", "sha").agg(F.count(F.lit(1)).alias("n")).alias("each")
    kept = keep.withColumn("stays", F.lit(True)).alias("keep")
    marked = each.join(kept, F.col("each.id").eqNullSafe(F.col("keep.id")) & (F.col("each.sha") == F.col("keep.sha")), "left")
    # Rows that go, and rows that stay but are there several times.
    odd = stored(marked.where("stays is null or n > 1").select("each.id", "each.sha", F.col("stays").isNotNull().alias("again")), "odd")
    counts = odd.agg(F.count(F.lit(1)).alias("n"), F.count_if("again").alias("again")).first()
    small = counts["n"] <= BROADCAST_ROWS
    text = F.coalesce(F.col(f"d.`{text_col}`"), F.lit(""))

    def same() -> Column:
        return F.col(f"d.`{id_col}`").cast("long").eqNullSafe(F.col("odd.id")) & (F.xxhash64(text) == F.col("odd.sha"))

    out = (F.broadcast(odd) if small else odd).alias("odd")
    docs = docs.alias("d")
    single = docs.join(out, same(), "left_anti")
    if not counts["again"]:
        return single
    again = odd.where("again")
    again = (F.broadcast(again) if small else again).alias("odd")
    # By id and text: other texts with this id, or without one, are rows of their own.
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"d.`{id_col}`").cast("long").alias("id"), F.xxhash64(text).alias("sha"))
    once = row.join(again, F.col("row")[id_col].cast("long").eqNullSafe(F.col("odd.id")) & (row.sha == F.col("odd.sha")), "left_semi").dropDuplicates(["id", "sha"])
    return single.union(once.select("row.*"))


def mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


STEP = np.uint64(0x9E3779B97F4A7C15)
FACTORS = mixed(np.arange(1, BANDS * BAND_ROWS + 1, dtype=np.uint64) * STEP) | np.uint64(1)


def members(hashes: np.ndarray) -> np.ndarray:
    """The shingles as a set: the second, third, ... of equal ones get numbers of their own."""
    h = np.sort(hashes)
    at = np.arange(len(h))
    first = np.maximum.accumulate(np.where(np.append(True, h[1:] != h[:-1])[: len(h)], at, 0))
    return mixed(h + (at - first).astype(np.uint64) * STEP)


def buckets_of(hashes: np.ndarray) -> np.ndarray:
    """One number for each band of minima; none for a text without words."""
    if not len(hashes):
        return np.empty(0, np.uint64)
    h = members(hashes)
    low = np.min([(h[i : i + 1024, None] * FACTORS).min(axis=0) for i in range(0, len(h), 1024)], axis=0).reshape(BANDS, BAND_ROWS)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in range(BAND_ROWS):
        out = mixed(out * STEP ^ low[:, row])
    return out


def sketches(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``sha``, ``key`` (a hash of the words), ``fp`` and ``buckets`` of every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, fps, parts = [], [], []
        for t in batch.column(1).to_pylist():
            h = shingle_hashes(t, k)
            keys.append(xxhash.xxh64_intdigest(b" ".join(t.encode().lower().split()), SEED))
            fps.append(fingerprint(h))
            parts.append(buckets_of(h))
        ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.uint64), *parts]).view(np.int64)))
        longs = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (keys, fps)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *longs, lists], ["id", "sha", "key", "fp", "buckets"])

    return map_slices(keyed(docs, id_col, text_col), 1, run, "id long, sha long, key long, fp long, buckets array<long>")


def own_pivots(fp: np.ndarray, n: int = NEAR_PIVOTS) -> np.ndarray:
    """The distances (a row per pivot) of all fingerprints to some of them, each the farthest from those before."""
    rows, far, at = [], np.full(len(fp), 65, np.int8), 0
    while len(rows) < n and far[at]:
        rows.append(np.bitwise_count(fp ^ fp[at]).astype(np.int8))
        far = np.minimum(far, rows[-1])
        at = int(far.argmax())
    return np.array(rows)


def within(fp: np.ndarray, table: np.ndarray, a: int, who: np.ndarray, radius: int) -> np.ndarray:
    """Those of ``who`` that differ from ``a`` in at most ``radius`` bits, behind the table of pivot distances."""
    who = who[(np.abs(table[:, who] - table[:, a : a + 1]) <= radius).all(axis=0)]
    return who[np.bitwise_count(fp[who] ^ fp[a]) <= radius]


def near_links(fp: np.ndarray, sets: list[np.ndarray], threshold: float, radius: int = NEAR_RADIUS) -> list[tuple[int, int]]:
    """Pairs of the given texts that connect all whose sets of shingles are similar."""
    n, sizes, table = len(fp), np.array([len(s) for s in sets]), own_pivots(fp)
    _, what = np.unique(np.concatenate(sets), return_inverse=True)
    begin = np.cumsum(sizes) - sizes
    holders = np.repeat(np.arange(n), sizes)[np.argsort(what, kind="stable")]
    edge = np.concatenate([[0], np.cumsum(np.bincount(what))])
    left, out = np.ones(n, bool), []
    for root in range(n):
        todo = [root] if left[root] else []
        left[root] = False
        while todo:
            a = todo.pop()
            b = within(fp, table, a, np.flatnonzero(left), radius)
            b = b[np.minimum(sizes[b], sizes[a]) >= threshold * np.maximum(sizes[b], sizes[a])]
            if not len(b):
                continue
            mine = what[begin[a] : begin[a] + sizes[a]]
            both = np.bincount(np.concatenate([holders[edge[x] : edge[x + 1]] for x in mine]), minlength=n)[b]
            b = b[both / (sizes[a] + sizes[b] - both) >= threshold]
            left[b] = False
            todo += b.tolist()
            out += [(a, x) for x in b.tolist()]
    return out


def near_classes(docs: DataFrame, k: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``fp``, ``sha``, ``component_id`` and ``label`` of every row, by similarity of shingles."""

    def sets_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        held = [members(shingle_hashes(t, k)).tobytes() for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, pa.binary())], ["key", "shingles"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(texts: dict[int, tuple[int, bytes]]) -> list[tuple[int, int]]:
            name = list(texts)
            found = near_links(np.array([f for f, _ in texts.values()], np.int64).view(np.uint64), [np.frombuffer(s, np.uint64) for _, s in texts.values()], threshold)
            return [(name[a], name[b]) for a, b in found]

        bucket, texts = None, {}
        for batch in batches:
            out = []
            for at, key, fp, held in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != bucket:
                    out += close(texts) if len(texts) > 1 else []
                    bucket, texts = at, {}
                texts[key] = fp, held
            yield pa.RecordBatch.from_pylist([{"u": u, "v": v} for u, v in out], pa.schema([("u", pa.int64()), ("v", pa.int64())]))
        if len(texts) > 1:
            yield pa.RecordBatch.from_pylist([{"u": u, "v": v} for u, v in close(texts)], pa.schema([("u", pa.int64()), ("v", pa.int64())]))

    rows = stored(sketches(docs, k, id_col, text_col), "sketches")
    first = F.min(F.struct(F.col("id").isNull().alias("no"), "id", "sha")).alias("first")
    # fp and buckets follow from the words: any row of a key has them.
    distinct = stored(rows.groupBy("key").agg(first, F.first("fp").alias("fp"), F.first("buckets").alias("buckets")), "distinct")
    each = distinct.select("key", "fp", F.explode("buckets").alias("bucket"))
    shared = each.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("key").alias("x"), F.sum(F.shiftright("key", 32)).alias("s")).where("n > 1")
    buckets = shared.groupBy("n", "x", "s").agg(F.min("bucket").alias("bucket")).select("bucket")
    met = stored(each.join(buckets, "bucket").select("bucket", "key", "fp"), "met")
    asked = stored(distinct.join(met.select("key").distinct(), "key", "left_semi").select("key", "first.id", "first.sha"), "asked")
    asked = (F.broadcast(asked) if asked.count() <= BROADCAST_ROWS else asked).alias("a")
    texts = keyed(docs, id_col, text_col).alias("t")
    texts = texts.join(asked, F.col("t.id").eqNullSafe(F.col("a.id")) & (F.col("t.sha") == F.col("a.sha"))).select("a.key", "t.text")
    sets = stored(map_slices(texts, 1, sets_of, "key long, shingles binary"), "shingles")
    full = met.join(sets, "key").select("bucket", "key", "fp", "shingles")
    edges = full.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "u long, v long").distinct()
    found = components(edges)
    named = distinct.select("key", F.col("first.id").alias("id")).join(found.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    least = named.groupBy("label").agg(F.min("id").alias("component_id"))
    of = stored(named.join(least, "label").select("key", "label", "component_id"), "classes")
    return rows.join(of, "key").select("id", "fp", "sha", "component_id", "label")


def one_per_near_class(docs: DataFrame, k: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each class of ``near_classes`` the row with the least id
    and then hash of the text."""
    return staying(docs, near_classes(docs, k, threshold, id_col, text_col), ["label"], id_col, text_col)
