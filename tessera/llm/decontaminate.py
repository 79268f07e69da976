"""Benchmark decontamination (operator 7), with DataFrame functions only.

A document is held against benchmark items through windows of as many words as the item has. A
window meets the items of its size with which it shares a shingle of ``k`` words; with all others it
has similarity zero, so nothing is lost by leaving them out. Windows and items get a SimHash, and a
window looks an item up by radius + 1 blocks of bits, of which one agrees if the fingerprints are
within ``radius`` bits. Pairs within the radius are verified: the shingles of window and item
are weighed by how often they occur, and the sum of the lesser weights over the sum of the greater
ones has to reach ``threshold``. A window has ``radius + 1`` look-ups for each item that it shares a
shingle with, however many items there are.

Votes of the 64 bits are added in lanes, several to a long (bytes, or wider ones for items of over
255 shingles). Windows are slices of pieces of a text's array of shingle hashes, ``SEGMENT`` starts
at a time, so a long text costs in proportion to its length, and nothing is sorted or shuffled by
word. The shuffles carry places (a few numbers per hit) and, once, the documents with hits. The
items' shingles and fingerprints are broadcast only up to ``BROADCAST_BYTES`` each; else the same
joins shuffle.

Defined cases. Words are lower-cased. A text of fewer than k words is one shingle; items
of fewer words are held against shingles of their own length. A document
shorter than an item is one window. Null and blank texts have no windows; items without words match
nothing. A null id is a key like any other; rows with equal id and text are one document, rows with
equal id and other text are told apart. Repeated items match each by itself. Empty tables give an
empty result or, for ``clean``, all rows. Other columns are ignored and kept by ``clean``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stored, words

K = 5
#: Of pairs of similarity 0.8 some 1 in 10,000 is expected to differ in more bits (1 in 100 beyond 16).
RADIUS = 20
THRESHOLD = 0.8
#: Bytes of the items' shingles or fingerprints that are broadcast at most.
BROADCAST_BYTES = 1 << 26
#: Windows are made for so many starts of a text at a time.
SEGMENT = 256
FULL = (1 << 64) - 1


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shingles(w: Column, k: int) -> Column:
    """Hashes of all shingles of an array of words, repeats included.

    ``w`` has to be a column of its own: an expression would be made again for each shingle.
    """
    # Single elements, as a slice of an array inside a lambda copies the whole array. The hash passes
    # over nulls, so that places behind the end add nothing.
    starts = F.sequence(F.lit(0), F.greatest(F.size(w) - k, F.lit(0)))
    return F.when(F.size(w) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)])))


def simhash(hashes: Column, lane: int) -> Column:
    """The majority of each bit over an array of hashes; ``lane`` bits hold a count."""
    ones = signed(sum(1 << b for b in range(0, 64, lane)))
    fields = (1 << lane) - 1 if lane < 64 else FULL
    zero = F.lit(0).cast("long")

    def add(shift: int) -> Column:
        return F.aggregate(hashes, zero, lambda a, h: a + F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(ones).cast("long")))

    n = F.size(hashes)
    lanes = [add(s) for s in range(lane)]

    def bits(sums: Column) -> Column:
        out = zero
        for b in range(64):
            votes = F.shiftrightunsigned(sums[b % lane], b // lane * lane).bitwiseAND(F.lit(signed(fields)).cast("long"))
            out = out.bitwiseOR(F.when(votes * 2 > n, F.lit(signed(1 << b)).cast("long")).otherwise(zero))
        return out

    # The sums are an array element bound by a lambda, so that each is made once per row.
    # Said not to be null, or Spark tests it by making it twice.
    return F.coalesce(F.transform(F.array(F.array(*lanes)), bits)[0], zero)


def blocks(fp: Column, radius: int) -> Column:
    """(number, value) of radius + 1 blocks of bits."""
    edge = [64 * i // (radius + 1) for i in range(radius + 2)]
    return F.array(*[F.struct(F.lit(i).alias("i"), F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (z - a)) - 1).cast("long")).alias("v")) for i, (a, z) in enumerate(zip(edge, edge[1:], strict=False))])


def first_block(differing: Column, radius: int) -> Column:
    """The number of the first block without a differing bit; null if there is none."""
    out = F.lit(None).cast("int")
    edge = [64 * i // (radius + 1) for i in range(radius + 2)]
    for i in reversed(range(radius + 1)):
        mask = signed(sum(1 << b for b in range(edge[i], edge[i + 1])))
        out = F.when(differing.bitwiseAND(F.lit(mask).cast("long")) == 0, i).otherwise(out)
    return out


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of two arrays of shingle hashes."""

    def times(of: Column, x: Column) -> Column:
        return F.size(F.filter(of, lambda y: y == x))

    # Without repeats on one side, common shingles count once; else the lesser of both counts.
    plain = (F.size(F.array_distinct(a)) == F.size(a)) | (F.size(F.array_distinct(b)) == F.size(b))
    counted = F.aggregate(F.array_distinct(b), F.lit(0), lambda n, x: n + F.least(times(a, x), times(b, x)))
    both = F.when(plain, F.size(F.array_intersect(a, b))).otherwise(counted)
    return both / (F.size(a) + F.size(b) - both)


def small(df: DataFrame, n_bytes: int) -> DataFrame:
    return F.broadcast(df) if n_bytes <= BROADCAST_BYTES else df


def matches(docs: DataFrame, items: DataFrame, k: int = K, radius: int = RADIUS, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``sha``, ``item_id``, ``start`` (word, from 0), ``n_words``, ``distance``, ``similarity``:
    the best window of each document for each item it holds."""
    size = F.size(words(F.lower(F.coalesce("text", F.lit("")))))
    # At most k - 1 sizes.
    short = sorted(r[0] for r in items.select(size.alias("n")).where((F.col("n") > 0) & (F.col("n") < k)).distinct().collect())
    out = matches_of(docs, items.where(size >= k) if short else items, k, radius, threshold, id_col, text_col)
    for n in short:
        out = out.union(matches_of(docs, items.where(size == n), n, radius, threshold, id_col, text_col))
    return out


def matches_of(docs: DataFrame, items: DataFrame, k: int, radius: int, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """``matches`` with shingles of k words for all items."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("sha"), text.alias("text"))
    pairs = candidates(keyed, items, k, radius)
    scored = pairs.select("id", "sha", "item_id", "start", "n_words", "distance", similarity(F.col("wsh"), F.col("ish")).alias("similarity")).where(F.col("similarity") >= threshold)
    best = scored.groupBy("id", "sha", "item_id").agg(F.max(F.struct("similarity", -F.col("start"), "n_words", "distance")).alias("m"))
    return best.select("id", "sha", "item_id", (-F.col("m.col2")).cast("long").alias("start"), F.col("m.n_words").cast("long").alias("n_words"), F.col("m.distance").cast("long").alias("distance"), F.col("m.similarity").alias("similarity"))


def windows(keyed: DataFrame, bench: DataFrame, k: int, lane: int, n_shingles: int) -> DataFrame:
    """``id``, ``sha``, ``n``, ``start``, ``item``, ``wsh``, ``fp``: each window with each item of its
    size that it shares a shingle with."""
    sought = bench.select(F.explode(F.array_distinct("ish")).alias("h"), "n", "item")

    # Outer generators: for inner ones Spark infers a test of the array, which makes the array twice
    # and, pushed below it, once for each element.
    places = keyed.select("id", "sha", words(F.lower("text")).alias("w")).select("id", "sha", shingles(F.col("w"), k).alias("sh")).select("id", "sha", F.size("sh").alias("m"), F.posexplode_outer("sh").alias("p", "h"))
    width = F.greatest(F.col("n") - (k - 1), F.lit(1))
    met = places.join(small(sought, 32 * n_shingles), "h").withColumn("last", F.greatest(F.col("m") - width, F.lit(0)))
    met = met.withColumn("lo", F.greatest(F.least(F.col("p") - width + 1, "last"), F.lit(0))).withColumn("hi", F.least("p", "last"))
    part = F.explode_outer(F.sequence(F.floor(F.col("lo") / SEGMENT), F.floor(F.col("hi") / SEGMENT))).alias("part")
    hits = met.select("id", "sha", "n", "item", "lo", "hi", part).groupBy("id", "sha", "n", "part").agg(F.collect_set(F.struct("lo", "hi", "item")).alias("hits"))
    hits = stored(hits.groupBy("id", "sha").agg(F.collect_list(F.struct("n", "part", "hits")).alias("parts")), "hits")

    # Only texts with hits meet their hits; who they are is known to all tasks, if it is little.
    who = hits.select("id", "sha")
    own = small(who, 48 * who.count()).alias("own")
    found = keyed.alias("k").join(own, F.col("k.id").eqNullSafe(F.col("own.id")) & (F.col("k.sha") == F.col("own.sha")), "left_semi")
    found = found.join(hits.alias("h"), F.col("k.id").eqNullSafe(F.col("h.id")) & (F.col("k.sha") == F.col("h.sha"))).select("h.id", "h.sha", "parts", "text")
    found = found.select("id", "sha", "parts", words(F.lower("text")).alias("w")).select("id", "sha", "parts", shingles(F.col("w"), k).alias("sh"))

    # A generator copies the columns beside it into each of its rows, so these get pieces of the text of
    # bounded size: the shingles of all windows that begin in one part.
    def piece(x: Column) -> Column:
        size = F.greatest(x["n"] - (k - 1), F.lit(1))
        return F.struct(x["n"].alias("n"), x["part"].alias("part"), x["hits"].alias("hits"), F.slice("sh", (x["part"] * SEGMENT + 1).cast("int"), size + (SEGMENT - 1)).alias("psh"))

    pieces = found.select("id", "sha", F.explode_outer(F.transform("parts", piece)).alias("x")).select("id", "sha", "x.*")
    # Few bytes, but much to do for each: dealt out evenly, in a number that Spark does not cut down.
    pieces = pieces.repartition(int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # An item and a place in the part as one number, as structs are compared pair by pair.
    begin = F.col("part") * SEGMENT
    pairs = F.array_distinct(F.flatten(F.transform("hits", lambda c: F.transform(F.sequence(F.greatest(c["lo"].cast("long"), begin), F.least(c["hi"].cast("long"), begin + (SEGMENT - 1))), lambda s: c["item"] * SEGMENT + (s - begin)))))

    # What is bound by a lambda, or comes from a generator, is made once; else each use would make it again.
    def printed(pair: Column) -> Column:
        every = F.sequence(F.lit(0), F.lit(SEGMENT - 1))
        used = F.array_distinct(F.transform(pair, lambda x: F.pmod(x, F.lit(SEGMENT)).cast("int")))
        prints = F.transform(F.array(used), lambda u: F.transform(every, lambda j: F.when(F.array_contains(u, j), simhash(F.slice("psh", j + 1, width), lane))))
        return F.struct(pair.alias("pairs"), prints[0].alias("prints"))

    made = pieces.select("id", "sha", "n", "part", "psh", F.explode_outer(F.transform(F.array(pairs), printed)).alias("y")).select("id", "sha", "n", "part", "psh", "y.*")
    rows = made.select("id", "sha", "n", "part", "psh", "prints", F.explode_outer("pairs").alias("pair"))
    at = F.pmod("pair", F.lit(SEGMENT)).cast("int")
    return rows.select("id", "sha", "n", (F.col("part") * SEGMENT + at).cast("int").alias("start"), F.floor(F.col("pair") / SEGMENT).alias("item"), F.slice("psh", at + 1, width).alias("wsh"), F.get("prints", at).alias("fp"))


def candidates(keyed: DataFrame, items: DataFrame, k: int, radius: int) -> DataFrame:
    """Windows and items of their size that share a shingle and whose fingerprints are within the radius."""
    bench = items.select("item_id", words(F.lower(F.coalesce("text", F.lit("")))).alias("w")).where(F.size("w") > 0)
    bench = stored(bench.select("item_id", F.monotonically_increasing_id().alias("item"), F.size("w").alias("n"), shingles(F.col("w"), k).alias("ish")), "items")
    size = bench.agg(F.max(F.size("ish")).alias("most"), F.count(F.lit(1)).alias("n"), F.sum(F.size("ish")).alias("shingles")).first()
    lane = next(x for x in (8, 16, 32, 64) if (size["most"] or 1) < 1 << x)
    n_shingles = size["shingles"] or 0
    asked = bench.withColumn("ifp", simhash(F.col("ish"), lane)).select("item", "ifp", F.explode(blocks(F.col("ifp"), radius)).alias("block"))
    differing = F.col("fp").bitwiseXOR(F.col("ifp"))
    near = F.bit_count(differing)
    # A pair meets in every block that agrees; it goes on from the first.
    met = (near <= radius) & (first_block(differing, radius) == F.col("block.i"))
    probes = windows(keyed, bench, k, lane, n_shingles).select("*", F.explode(blocks(F.col("fp"), radius)).alias("block"))
    pairs = probes.join(small(asked, 48 * (radius + 1) * size["n"]), ["item", "block"]).where(met)
    own = small(bench.select("item", "item_id", "ish"), 64 * size["n"] + 8 * n_shingles)
    return pairs.select("id", "sha", "item", "start", F.col("n").alias("n_words"), near.alias("distance"), "wsh").join(own, "item")


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item."""
    held = stored(matches(docs, items, id_col=id_col, text_col=text_col).select("id", "sha").distinct(), "held").alias("held")
    same = F.col(f"d.`{id_col}`").eqNullSafe(F.col("held.id")) & (F.xxhash64(F.coalesce(F.col(f"d.`{text_col}`"), F.lit(""))) == F.col("held.sha"))
    return docs.alias("d").join(held, same, "left_anti")
