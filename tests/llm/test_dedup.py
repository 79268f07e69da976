"""Chunk dedup, SimHash and decontamination against brute force, with the odd cases."""

import random
import re
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import chunks, decontaminate, simhash, warc

DOCS = "doc_id long, text string, fp long, component_id long, places string, sha long"


def sentence(rng, n, pool=4000):
    return " ".join(f"w{rng.randrange(pool)}x" for _ in range(n))


def documents(spark, seed=3):
    rng = random.Random(seed)
    passage = sentence(rng, 90)
    base = [sentence(rng, rng.randrange(5, 300)) for _ in range(40)]
    texts = base + base[:6] + [b.replace("w1", "w2", 1) for b in base[6:20]] + [f"{sentence(rng, 60)} {passage} {sentence(rng, 60)}" for _ in range(5)]
    texts += [None, "", "", " \n\t ", "one", "one", "two words", "é" * 3000, "x" * 200_000, ("lorem ipsum dolor " * 4000)]
    rows = [(i, t, 1, 2, "p", 3) for i, t in enumerate(texts)]
    rows += [(None, "no id at all here", 1, 2, "p", 3), (3, base[3], 1, 2, "p", 3), (5, "same id but another text of some words", None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


def words(t):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) if w]


def slow_fingerprint(t, k=4):
    w = words(t)
    sh = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_classes(rows, radius):
    """id -> least id of its component, by comparing all pairs."""
    fps = [(i, slow_fingerprint(t)) for i, t in rows]
    group = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for a in range(len(fps)):
            for b in range(a):
                if (fps[a][1] ^ fps[b][1]).bit_count() <= radius and group[a] != group[b]:
                    group = [min(group[a], group[b]) if g in (group[a], group[b]) else g for g in group]
                    changed = True
    least = {}
    for (i, _), g in zip(fps, group, strict=True):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    return [(i, f, least.get(g)) for (i, f), g in zip(fps, group, strict=True)]


def test_simhash_equals_brute_force(spark):
    docs = documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = Counter((r.id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.classes(docs).collect())
    assert got == Counter(slow_classes(rows, 4))


def test_large_buckets_are_cut_without_loss(spark):
    rng = random.Random(5)
    hub = rng.getrandbits(64)
    fps = {hub} | {hub ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(300)} | {rng.getrandbits(64) for _ in range(300)}
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    want = None
    for limit in (10_000, 40, 2):
        c = {r.node: r.label for r in simhash.components(simhash.links(df, 4, limit)).collect()}
        assert want is None or c == want
        want = c
    linked = {x for x in fps if any(x != y and (x ^ y).bit_count() <= 4 for y in fps)}
    assert {n & (1 << 64) - 1 for n in want} == linked


def test_odd_radii_and_clusters_lose_no_link(spark):
    rng = random.Random(15)
    hub = rng.getrandbits(64)
    flip = lambda x, n: x ^ sum(1 << b for b in rng.sample(range(64), n))
    for radius in (1, 3):
        fps = {flip(hub, rng.randrange(5)) for _ in range(150)} | {rng.getrandbits(64) for _ in range(100)}
        fps |= {flip(x, radius) for x in list(fps)[:40]}
        df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
        want = list(range(len(fps)))
        own = list(fps)
        for a, x in enumerate(own):
            for b in range(a):
                if (x ^ own[b]).bit_count() <= radius and want[a] != want[b]:
                    want = [min(want[a], want[b]) if w in (want[a], want[b]) else w for w in want]
        groups = {frozenset(own[i] for i, w in enumerate(want) if w == g) for g in set(want)}
        for found in (simhash.links(df, radius, 1000), simhash.links(df, radius, 30), simhash.dense_links(df, radius)):
            got = {}
            for r in simhash.components(found).collect():
                got.setdefault(r.label, set()).add(r.node & (1 << 64) - 1)
            assert {frozenset(x) for x in got.values()} == {g for g in groups if len(g) > 1}


def test_large_buckets_are_grown_like_small_ones(monkeypatch):
    rng = np.random.default_rng(3)
    fp = rng.integers(0, 1 << 63, 700, dtype=np.uint64)
    for k in range(1, 600):
        fp[k] = fp[rng.integers(0, k)] ^ (np.uint64(1) << rng.integers(0, 64, dtype=np.uint64)) if k % 3 else fp[k]
    fp = rng.permutation(np.unique(fp))
    ends = np.array([5, 300, 301, len(fp)])

    def groups():
        label = {int(x): int(x) for x in fp}
        for u, v in zip(*simhash.bucket_links(fp, ends, 2), strict=True):
            label[int(u)] = int(v)
        out = {}
        for x, y in label.items():
            out.setdefault(y, set()).add(x)
        return {frozenset(x) for x in out.values()}

    want = groups()
    monkeypatch.setattr(simhash, "ALL_PAIRS", 20)
    assert groups() == want and max(map(len, want)) > 20


def test_pivots_lose_no_pair():
    rng = np.random.default_rng(1)
    fp = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    fp[150:] = fp[:150] ^ (np.uint64(1) << rng.integers(0, 64, 150, dtype=np.uint64))
    found = {(int(a), int(b)) for x, y in simhash.verified(fp, np.full(300, 300), 4) for a, b in zip(x, y, strict=True)}
    assert found == {(a, b) for a in range(300) for b in range(a + 1, 300) if int(fp[a] ^ fp[b]).bit_count() <= 4}


def test_one_of_each_class_stays(spark):
    docs = documents(spark)
    kept = simhash.one_per_class(docs)
    assert kept.columns == docs.columns
    want = {c for *_, c in slow_classes([(r.doc_id, r.text) for r in docs.collect()], 4)}
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and set(ids) == want


def test_repeated_texts_without_ids_all_stay(spark):
    docs = spark.createDataFrame([(None, "x y"), (None, "x y"), (None, "some other words"), (None, "some other words"), (7, "one with id"), (7, "one with id")], "doc_id long, text string")
    assert sorted(r.text for r in simhash.one_per_class(docs).collect()) == ["one with id", "some other words", "x y"]


def slow_near(texts, k=5, threshold=0.8):
    """Components of the pairs that reach the similarity, as a label per text, by comparing all pairs."""
    sets = [Counter(tuple(words(t)[i : i + k]) for i in range(max(1, len(words(t)) - k + 1))) for t in texts]
    group = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            both = (sets[a] & sets[b]).total()
            if group[a] != group[b] and both / (sets[a].total() + sets[b].total() - both) >= threshold:
                group = [min(group[a], group[b]) if g in (group[a], group[b]) else g for g in group]
    return group


def test_near_copies_of_nothing(spark):
    none = spark.createDataFrame([], DOCS)
    assert simhash.near_classes(none).count() == 0 and simhash.one_per_near_class(none).count() == 0


def test_near_copies_equal_brute_force(spark):
    rng = random.Random(17)
    texts = [r.text for r in documents(spark).collect()]
    for n in (8, 30, 150, 400):
        for _ in range(6):
            w = sentence(rng, n).split()
            texts.append(" ".join(w))
            for share in (0.01, 0.02, 0.04, 0.1):
                texts.append(" ".join("other" if rng.random() < share else x for x in w))
            texts += [" ".join(w[n // 6 :]), " ".join(w[: n - n // 5 - 4]).upper()]
    hub = sentence(rng, 150).split()
    texts += [" ".join(x if rng.random() > 0.03 else f"w{rng.randrange(4000)}x" for x in hub) for _ in range(150)]
    # Ids twice, and none: classes are told apart by more than their ids.
    docs = spark.createDataFrame([(None if i % 9 == 0 else i // 2, t) for i, t in enumerate(texts)], "doc_id long, text string")
    want = slow_near(texts)
    label = {}
    for r in simhash.near_classes(docs).collect():
        label.setdefault(r.label, set()).add((r.id, r.sha))
    sha = [r.sha for r in docs.selectExpr("xxhash64(coalesce(text, '')) AS sha").collect()]
    expected = {}
    for i, g in enumerate(want):
        expected.setdefault(g, set()).add((None if i % 9 == 0 else i // 2, sha[i]))
    assert sorted(map(str, map(sorted, ([tuple(map(str, x)) for x in c] for c in label.values())))) == sorted(map(str, map(sorted, ([tuple(map(str, x)) for x in c] for c in expected.values()))))
    kept = simhash.one_per_near_class(docs)
    assert kept.columns == docs.columns and kept.count() == len(expected) < len(set(texts))


def test_near_copies_come_through_the_pivot_table(monkeypatch):
    rng = np.random.default_rng(8)
    hubs = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
    flips = rng.random((90, 64)) < 0.12
    fp = hubs[np.arange(90) % 3] ^ np.packbits(flips, axis=1, bitorder="little").view("<u8").ravel()
    table, every = simhash.own_pivots(fp), np.arange(90)
    left = 0
    for a in range(90):
        want = {b for b in range(90) if int(fp[a] ^ fp[b]).bit_count() <= 20}
        assert set(simhash.within(fp, table, a, every, 20).tolist()) == want
        left += int((np.abs(table - table[:, a : a + 1]) <= 20).all(axis=0).sum())
    assert left < 90 * 90
    # Texts of the same shingles are linked, unless the table or the fingerprints part them.
    sets = [np.arange(50, dtype=np.uint64)] * 90
    label = list(range(90))
    for a, b in simhash.near_links(fp, sets, 0.8, 20):
        label = [min(label[a], label[b]) if x in (label[a], label[b]) else x for x in label]
    slow = list(range(90))
    for a in range(90):
        for b in range(a):
            if int(fp[a] ^ fp[b]).bit_count() <= 20 and slow[a] != slow[b]:
                slow = [min(slow[a], slow[b]) if x in (slow[a], slow[b]) else x for x in slow]
    assert label == slow
    asked = []
    monkeypatch.setattr(simhash, "own_pivots", lambda x: asked.append(len(x)) or table[:, : len(x)])
    simhash.near_links(fp, sets, 0.8, 20)
    assert asked == [90]
    assert len(simhash.own_pivots(fp[:1])) == 8 and simhash.near_links(fp[:1], sets[:1], 0.8) == []


def test_stars_keep_links_of_earlier_blocks(monkeypatch):
    """Random graphs whose edges come in two blocks, against plain union."""
    rng = np.random.default_rng(4)
    for _ in range(5000):
        n = int(rng.integers(4, 12))
        blocks = [np.sort(rng.integers(0, n, (int(rng.integers(1, n)), 2)), axis=1) for _ in range(2)]
        monkeypatch.setattr(simhash, "verified", lambda *_, b=blocks: iter([(x[:, 0], x[:, 1]) for x in b]))
        want = list(range(n))
        for a, b in np.concatenate(blocks).tolist():
            want = [min(want[a], want[b]) if w in (want[a], want[b]) else w for w in want]
        u, v = simhash.stars(np.arange(n, dtype=np.uint64), np.full(n, n), 4)
        got = list(range(n))
        for x, y in zip(u.tolist(), v.tolist(), strict=True):
            got[x] = y
        assert got == want


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    items = spark.createDataFrame([], "item_id long, text string")
    assert simhash.classes(none).count() == 0 and simhash.one_per_class(none).count() == 0
    assert chunks.report(none).count() == 0 and chunks.deduplicated(none).count() == 0
    assert decontaminate.matches(none, items).count() == 0
    some = documents(spark)
    assert decontaminate.clean(some, items).count() == some.count()


def slow_ends(raw):
    """Chunk ends by the rule of the module's docstring, a byte at a time."""
    table = [xxhash.xxh32_intdigest(bytes([b]), 1) for b in range(256)]
    starts = {i for i in range(len(raw) + 1) if i == len(raw) or raw[i] & 0xC0 != 0x80}
    out, at, blank_at = [], 0, 0
    for i in range(1, len(raw) + 1):
        h = 0
        for b in raw[max(0, i - 16) : i]:
            h = (h << 1) + table[b] & 0xFFFFFFFF
        if raw[i - 1] in b" \t\n\v\f\r":
            blank_at, may = i, h >> 31 == 0
        else:
            may = i - blank_at >= 64 and h >> 28 == 0 and i < len(raw) and i in starts
        forced = i - at > 256 and i in starts
        if i == len(raw) or forced or may and i - at >= 16 or i - at == 256 and i in starts:
            out.append(i)
            at = i
    return out


def slow_cuts(rows):
    """Kept text per distinct (id, text), by looking each chunk up in what came before."""
    seen, out = {}, {}
    for i, t in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        raw = (t or "").encode()
        at, runs = 0, []
        for e in slow_ends(raw):
            first = seen.setdefault(raw[at:e], (i, at))
            if first != (i, at):
                if runs and runs[-1][1] == at:
                    runs[-1][1] = e
                else:
                    runs.append([at, e])
            at = e
        kept, at = b"", 0
        for b, e in runs:
            if e - b >= chunks.MIN_RUN:
                kept, at = kept + raw[at:b], e
        out[i, t] = (kept + raw[at:]).decode()
    return out


def test_chunk_ends_equal_brute_force():
    rng = random.Random(31)
    texts = [sentence(rng, 200), "漢字仮名" * 200, "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(900)), "x" * 1000, "\n".join(sentence(rng, 7) for _ in range(30)), "é" * 400 + " " + "q" * 90, "", " ", "ab cd"]
    raws = [t.encode() for t in texts]
    stops = np.cumsum([len(r) for r in raws])
    got = chunks.ends_of(np.frombuffer(b"".join(raws), np.uint8), stops - [len(r) for r in raws], stops)
    base = (stops - [len(r) for r in raws]).tolist()
    assert [[e - b for e in ends] for b, ends in zip(base, got, strict=True)] == [slow_ends(r) for r in raws]


def test_chunks_equal_brute_force(spark):
    docs = documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {(r.doc_id, r.text) for r in chunks.report(docs).collect()}
    want = {(i, None if t is None else kept) for (i, t), kept in slow_cuts(rows).items()}
    assert got == want
    assert chunks.deduplicated(docs).columns == docs.columns and chunks.deduplicated(docs).count() == len(rows)


def test_chunks_resist_insertions():
    rng = random.Random(2)
    a = (sentence(rng, 3000)).encode()
    b = a[:500] + b"inserted words here " + a[500:]
    parts = []
    for raw in (a, b):
        ends = chunks.ends_of(np.frombuffer(raw, np.uint8), np.array([0]), np.array([len(raw)]))[0]
        parts.append({raw[x:y] for x, y in zip([0, *ends], ends, strict=False)})
        assert all(y - x <= chunks.MAX_BYTES + 4 for x, y in zip([0, *ends], ends, strict=False)) and ends[-1] == len(raw)
    assert len(parts[0] - parts[1]) <= 6


def test_repeated_passage_is_cut_once_kept(spark):
    rng = random.Random(8)
    passage = sentence(rng, 90)
    docs = spark.createDataFrame([(i, f"{sentence(rng, 50)} {passage} {sentence(rng, 50)}") for i in range(6)], "doc_id long, text string")
    r = {x.doc_id: x for x in chunks.report(docs).collect()}
    assert r[0].removed_bytes == 0 and passage in r[0].text
    assert all(x.removed_bytes > 0.4 * len(passage) for i, x in r.items() if i)


def test_passages_just_over_fifty_words_are_cut(spark):
    rng = random.Random(12)
    passages = [sentence(rng, rng.randrange(51, 61)) for _ in range(150)]
    docs = [(2 * i + j, f"{sentence(rng, rng.randrange(20, 60))} {p} {sentence(rng, rng.randrange(20, 60))}") for i, p in enumerate(passages) for j in range(2)]
    r = {x.doc_id: x.removed_bytes for x in chunks.report(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    share = [r[2 * i + 1] / len(p) for i, p in enumerate(passages)]
    assert all(r[2 * i] == 0 for i in range(150))
    assert min(share) > 0 and sum(x < 0.5 for x in share) <= 3 and sum(share) / 150 > 0.8


def test_repeats_without_blanks_are_cut_at_any_offset(spark):
    rng = random.Random(13)
    for letters in ("".join(map(chr, range(0x4E00, 0x5E00))), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"):
        passage, other = ("".join(rng.choice(letters) for _ in range(1500)) for _ in range(2))
        docs = [(1, other[:700] + passage), (2, "a few words " + other[700:811] + passage), (3, passage[:600] + "X" + passage[600:])]
        r = {x.doc_id: x for x in chunks.report(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
        assert r[1].removed_bytes == 0 and min(r[2].removed_bytes, r[3].removed_bytes) > 0.8 * len(passage.encode())


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(11)
    items = [(i, sentence(rng, rng.randrange(8, 40))) for i in range(20)] + [(20, items_text := "four words only here"), (21, None), (22, " "), (23, items_text)]
    held = []
    for i, t in items[:10]:
        w = t.split()
        held += [f"{sentence(rng, 30)} {t.upper()} {sentence(rng, 10)}", f"{sentence(rng, 9)} {' '.join(w[1:])} {sentence(rng, 9)}", " ".join(w[: len(w) // 2]), t]
    docs = documents(spark).unionByName(spark.createDataFrame([(1000 + i, t, 1, 2, "p", 3) for i, t in enumerate([*held, "four words only here"])], DOCS))
    bench = spark.createDataFrame(items, "item_id long, text string")

    def shingles(t):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").lower()) if x]
        return [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []

    want = {}
    for d in {(r.doc_id, r.text) for r in docs.collect()}:
        s = shingles(d[1])
        for i, t in items:
            c = Counter(shingles(t))
            m, best = sum(c.values()), 0.0
            if not c or not set(s) & set(c):
                continue
            for a in range(max(1, len(s) - m + 1)):
                q = Counter(s[a : a + m])
                both = sum((q & c).values())
                best = max(best, both / (sum(q.values()) + m - both))
            if best >= 0.8:
                want[d[0], i] = round(best, 9)
    got = {(r.id, r.item_id): round(r.similarity, 9) for r in decontaminate.matches(docs, bench).collect()}
    assert got == want and len(want) >= 20
    clean = decontaminate.clean(docs, bench)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect()} - {i for i, _ in want}


def test_short_items_and_wide_pairs_are_found(spark):
    rng = random.Random(23)
    items = [(i, sentence(rng, 35)) for i in range(800)] + [(900, "three rare words"), (901, "single")]
    held = [(i, " ".join(t.split()[:32]) + " and other ends") for i, t in items[:800]] + [(900, "here are Three rare words too inside"), (901, "a single one of many words"), (902, "three rare other words")]
    found = decontaminate.matches(spark.createDataFrame(held, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.id, r.item_id) for r in found.select("id", "item_id").collect()}
    assert got <= {(i, i) for i, _ in items} and {(900, 900), (901, 901)} <= got
    assert len(got) >= 801


def test_windows_meet_only_items_they_share_a_shingle_with(spark):
    rng = random.Random(29)
    items = [(i, sentence(rng, 20 + i % 2)) for i in range(300)]
    texts = [sentence(rng, 400) for _ in range(3)]
    texts += [f"{sentence(rng, 290)} {' '.join(items[0][1].split()[3:9])} {sentence(rng, 300)} {items[1][1]}", items[2][1][:40], f"{items[4][1]} " * 30]
    texts.append(" ".join(x for i in range(260) for x in (items[i % 40][1], sentence(rng, rng.randrange(9)))))
    want = Counter()
    for d, t in enumerate(texts):
        s = [tuple(words(t)[i : i + 5]) for i in range(max(1, len(words(t)) - 4))]
        for i, x in items:
            own, m = {tuple(words(x)[j : j + 5]) for j in range(len(words(x)) - 4)}, len(words(x)) - 4
            want[d] += sum(not own.isdisjoint(s[a : a + m]) for a in range(max(1, len(s) - m + 1)))
    keyed = spark.createDataFrame(list(enumerate(texts)), "id long, text string").selectExpr("id", "xxhash64(text) AS sha", "text")
    bench = spark.createDataFrame(items, "item long, text string").select("item", decontaminate.words(F.col("text")).alias("w"))
    bench = bench.select("item", F.size("w").alias("n"), decontaminate.shingles(F.col("w"), 5).alias("ish"))
    got = Counter({r.id: r.n for r in decontaminate.windows(keyed, bench, 5, 8, 5000).groupBy("id").agg(F.count("fp").alias("n")).collect()})
    assert got == +want and got[0] + got[1] + got[2] == 0 and got[6] > 5000


def test_a_very_long_text_is_searched_in_proportion(spark):
    rng = random.Random(37)
    items = [(i, sentence(rng, 30, 10**6)) for i in range(50)]
    text = " ".join(f"{sentence(rng, 900, 10**6)} {items[i % 50][1]}" for i in range(300))
    docs = spark.createDataFrame([(1, text), (2, items[7][1])], "doc_id long, text string")
    got = decontaminate.matches(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.id, r.item_id, r.similarity) for r in got} == {(1, i, 1.0) for i in range(50)} | {(2, 7, 1.0)}


def test_the_id_may_have_any_name(spark):
    rng = random.Random(19)
    item, twice = sentence(rng, 20), sentence(rng, 90)
    rows = [(1, f"{sentence(rng, 40)} {item}", 5), (2, twice, 5), (3, twice, 5), (3, twice, 5), (None, "no id", 5)]
    docs = spark.createDataFrame(rows, "id long, body string, sha long")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    kept = decontaminate.clean(docs, bench, "id", "body")
    assert kept.columns == docs.columns and sorted(str(r.id) for r in kept.collect()) == ["2", "3", "3", "None"]
    for one in (simhash.one_per_class(docs, id_col="id", text_col="body"), simhash.one_per_near_class(docs, id_col="id", text_col="body")):
        assert one.columns == docs.columns and sorted(str(r.id) for r in one.collect()) == ["1", "2", "None"]
    cut = chunks.deduplicated(docs, "id", "body")
    assert cut.columns == docs.columns and cut.count() == 5


def test_results_do_not_depend_on_broadcasts(spark, monkeypatch):
    docs = documents(spark)
    some = [r.text for r in docs.where("doc_id < 5").collect()]
    items = spark.createDataFrame([(i, " ".join(t.split()[:12])) for i, t in enumerate(some)], "item_id long, text string")
    pages = spark.createDataFrame([(i, "u", "ab"[i % 2] * 9) for i in range(9)], "page_id long, url string, html string")

    def results():
        out = [Counter(tuple(r) for r in chunks.deduplicated(docs).select("doc_id", "text").collect())]
        out.append(Counter(tuple(r) for r in decontaminate.matches(docs, items).collect()))
        out.append(Counter(r.doc_id for r in simhash.one_per_near_class(docs).collect()))
        out.append(Counter((r.page_id, r.record_type, r.refers_to) for r in warc.round_trip(spark, pages).collect()))
        return out

    want = results()
    for module, name in ((chunks, "BROADCAST_TEXTS"), (decontaminate, "BROADCAST_BYTES"), (simhash, "BROADCAST_ROWS"), (warc, "BROADCAST_DIGESTS")):
        monkeypatch.setattr(module, name, -1)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert results() == want and len(want[1]) >= 5
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_native_plan_has_no_python(spark):
    plan = decontaminate.matches(documents(spark), spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert isinstance(documents(spark).schema, T.StructType)
