"""BPE, WARC, chat, toxicity, quality, language model and co-training, with the odd cases."""

import gzip
import hashlib
import io
import math
import os
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import bpe, chat, common, cotrain, hashstore, lm, quality, toxicity, warc
from tessera.llm.common import scratch
from tessera.plans import store

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " \n\t ", "one", "Two words", "ΑΣ ΣΑΣ İ", "x<|endoftext|>y <|EndOfText|>", "don't 'S 1234 ½", "á é 漢字 한국 🙂", "a" * 3000, "\x00\x1f\x85 ​", "𞤀 ՘ ̣࢘"]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    made = [" ".join("".join(rng.choice("aeinrst") for _ in range(rng.randrange(1, 7))) for _ in range(rng.randrange(1, 200))) for _ in range(60)]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", None]), rng.choice([None, 5, -1])) for i, t in enumerate([*ODD, *made, *made[:5]])]
    return spark.createDataFrame([*rows, (None, "no id", None, None, None), rows[-1]], "doc_id long, text string, lang string, source string, n_chars long")


def test_tokens_equal_the_library(spark, docs):
    ref = Tokenizer.from_file(PATH)
    rows = docs.select("doc_id", "text").collect()
    got = Counter((r.doc_id, tuple(r.ids), r.decoded) for r in bpe.encode_documents(docs, PATH).collect())
    want = Counter()
    for r in rows:
        ids = ref.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id, tuple(ids), ref.decode(ids, skip_special_tokens=False)] += 1
    assert got == want
    digests = {(r.doc_id, r.n_tokens, r.ids_sha256) for r in bpe.token_digests(docs, PATH).collect()}
    assert digests == {(i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()) for i, ids, _ in want}


def test_words_equal_plain_merging():
    b = bpe.load(PATH)
    names = {v: k for k, v in __import__("json").load(open(PATH))["model"]["vocab"].items()}
    vocab = {v: k for k, v in names.items()}
    rng = random.Random(9)
    for _ in range(400):
        w = "".join(rng.choice("aehinorst") for _ in range(rng.randrange(1, 30)))
        parts = [vocab[c] for c in w[:-1]] + [vocab[w[-1] + "</w>"]]
        while True:
            best = min(((b.merged[p], i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in b.merged), key=lambda x: (b.rank[x[0]], x[1]), default=None)
            if best is None:
                break
            parts[best[1] : best[1] + 2] = [best[0]]
        assert b.encode(w) == parts


def test_tokens_keep_other_columns(spark, docs):
    out = bpe.with_tokens(docs.withColumn("tokens", F.lit(1)), PATH)
    assert set(out.columns) == {*docs.columns, "tokens"} and out.count() == docs.count()
    assert bpe.encode_documents(docs.limit(0), PATH).count() == 0


def pages(spark):
    rows = [(i, f"http://h/{i}", t) for i, t in enumerate(["<p>a</p>", "<p>b</p>", "<p>a</p>", "", None, "é" * 70_000, "<p>a</p>"])]
    return spark.createDataFrame([*rows, (2, None, "<p>a</p>"), (None, "u", "<p>a</p>"), (9, "u\r\nX: y", "last")], "page_id long, url string, html string")


def test_warc_round_trip(spark):
    p = pages(spark)
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.error) for r in warc.round_trip(spark, p).collect())
    rows = [(r.page_id, (r.html or "").encode()) for r in p.collect()]
    best = {}
    for i, b in rows:
        if i is not None:
            best[b] = max(best.get(b, i), i)
    want = Counter((i, len(b), warc.b32(hashlib.sha1(b).digest()), "response" if i == best.get(b, i) else "revisit", None if i == best.get(b, i) else best[b], None) for i, b in rows)
    assert got == want
    small = warc.round_trip(spark, p, min_revisit_bytes=1)
    assert small.where("payload_bytes = 0 and record_type = 'revisit'").count() == 0 and small.where("record_type = 'revisit'").count() == 4
    assert warc.round_trip(spark, p.limit(0)).count() == 0


def test_warc_members_are_plain_gzip_and_keep_payloads(spark):
    files = warc.write_archives(pages(spark), scratch(spark, "warc-test"))
    payloads = {r.page_id: bytes(r.payload) for r in warc.read_archives(files, keep_payload=True).where("payload is not null").collect()}
    assert payloads[5] == ("é" * 70_000).encode()
    raw = b"".join(gzip.open(f.file).read() for f in files.collect())
    assert raw.count(b"WARC/1.1\r\n") == 10


def test_damaged_archives_are_told():
    body = warc.http_head(5) + b"hello"
    one = warc.record("response", 1, "u", warc.b32(hashlib.sha1(b"hello").digest()), 5, body, "2020-01-01T00:00:00Z")
    bad = warc.record("response", 2, "u", warc.b32(hashlib.sha1(b"other").digest()), 5, body, "2020-01-01T00:00:00Z")
    read = lambda raw: list(warc.Reader(io.BytesIO(raw)))
    assert [r.get("page_id") for r in read(one + one)] == [1, 1]
    assert read(one + bad)[1]["error"] == "the payload digest differs"
    for raw in (one + one[:-7], one + b"junk", one + one[:20]):
        assert read(raw)[0]["page_id"] == 1 and read(raw)[-1]["error"]
    assert read(b"") == []


def test_preferences(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "a"), (1, 2, "user", "b"), (1, 2, "user", "b"), (2, 0, "user", "hi"), (2, 1, "assistant", "a"), (2, 2, "user", "c"), (2, 3, "assistant", None), (3, 0, None, "x"), (None, 0, "user", "lost"), (4, None, "user", "hi")]
    t = spark.createDataFrame([(*x, 7) for x in turns], "conv_id long, turn long, role string, text string, pair_id long")
    p = spark.createDataFrame([(10, 1, 2), (11, 1, 1), (12, 1, 99), (13, None, 2), (14, 3, 4)], "pair_id long, chosen_id long, rejected_id long")
    r = {x.pair_id: x for x in chat.format_preferences(t, p).collect()}
    assert set(r) == {10, 11, 14}
    assert r[10].n_prompt_turns == 2 and r[10].prompt == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\na<|im_end|>\n"
    assert r[10].chosen == "<|im_start|>user\nb<|im_end|>\n" and r[10].rejected.endswith("<|im_start|>assistant\n<|im_end|>\n")
    assert r[10].rejected_mask == "0:29,0:22,1:11" and sum(int(x.split(":")[1]) for x in r[10].rejected_mask.split(",")) == len(r[10].rejected)
    assert r[11].chosen == r[11].rejected == r[11].chosen_mask == "" and r[11].n_prompt_turns == 3
    assert r[14].n_prompt_turns == 0 and r[14].prompt == ""
    assert chat.format_preferences(t.limit(0), p).count() == 0
    assert not re.search("Python|Pandas|Arrow", chat.format_preferences(t, p)._jdf.queryExecution().toString())


def toxic_corpus(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(600):
        w = ["".join(rng.choice("aeionrstld") for _ in range(rng.randrange(2, 7))) for _ in range(60)]
        bad = i % 5 == 0
        if bad:
            for k in rng.sample(range(60), 3):
                w[k] = rng.choice(["blarg", "b1arg", "blаrg", "zwompke", "zwompter", "ZWOMPA"])
        elif i % 49 < 1:
            w[9:11] = ["kind", "zwompke"]
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows + [(1000, None), (1001, ""), (None, "blarg blarg")], "doc_id long, text string")
    return docs, spark.createDataFrame(labels + [(1000, None), (None, 1)], "doc_id long, toxic int")


def test_toxicity_learns_folds_and_exceptions(spark):
    docs, labels = toxic_corpus(spark)
    lexicon = toxicity.fit(docs, labels, toxicity.held_out_fold(F.col("_key")))
    assert " kind zwompke " in lexicon.exceptions
    r = toxicity.scores(docs, lexicon).join(labels, "doc_id").where(toxicity.held_out_fold(F.col("doc_id"))).collect()
    assert len(r) > 100 and sum(x.predicted != x.toxic for x in r) <= 2
    assert all(0 <= x.score <= 1 for x in toxicity.scores(docs, lexicon).collect())
    kept = toxicity.clean(docs.withColumn("score", F.lit("own")), lexicon)
    assert kept.columns == ["doc_id", "text", "score"] and {1000, 1001} <= {x.doc_id for x in kept.collect()} and None not in {x.doc_id for x in kept.collect()}
    none = toxicity.fit(docs, labels.limit(0))
    assert toxicity.clean(docs, none).count() == docs.count() and toxicity.scores(docs.limit(0), lexicon).count() == 0
    assert toxicity.fold("Ｉdіоt! 1D10T a$$ 3 x5 ") == " idiot idiot a 3 x5 " or toxicity.fold("1D10T") == " idiot "


def slow_terms(w):
    return [f" {w} ", *(f" {w[:n]}" for n in (4, 5, 6, 7, 8) if len(w) > n)]


def slow_lexicon(rows, min_docs=5, min_contexts=4, min_weight=2.5):
    """Weights and exception phrases over plain dictionaries; rows of (words, label)."""
    a, b, contexts, size = Counter(), Counter(), defaultdict(set), Counter(y for _, y in rows)
    for w, y in rows:
        (a if y else b).update({t for x in w for t in slow_terms(x)})
        first = {}
        for i, x in enumerate(w):
            for t in slow_terms(x):
                first.setdefault(t, (w[i - 1] if i else "", w[i + 1] if i + 1 < len(w) else ""))
        for t, c in first.items() if y else ():
            contexts[t].add(c)
    weight = {t: math.log((a[t] + 0.5) / (size[1] + 1)) - math.log((b[t] + 0.5) / (size[0] + 1)) for t in a}
    picked = {t: w for t, w in weight.items() if a[t] >= min_docs and len(contexts[t]) >= min_contexts and w >= min_weight}
    weights = {t: w for t, w in picked.items() if not any(picked.get(t[: n + 1], 0) >= 0.8 * w for n in (4, 5, 6, 7, 8) if len(t.rstrip()) > n + 1)}
    phrases, toxic = Counter(), set()
    for w, y in rows:
        own = {f" {p} {q} " for p, q in zip(w, w[1:], strict=False) if set(slow_terms(p) + slow_terms(q)) & set(weights)}
        phrases.update(() if y else own)
        toxic |= own if y else set()
    return weights, {p for p, n in phrases.items() if n >= min_docs and p not in toxic}


def slow_matches(w, weights, phrases):
    t = f" {' '.join(w)} "
    places = lambda x: [i for i in range(len(t)) if t.startswith(x, i)]
    safe = [(i, i + len(p)) for p in phrases for i in places(p)]
    at = defaultdict(list)
    for x, v in weights.items():
        for i in places(x):
            at[i].append((v, len(x)))
    total = n = 0
    for i, found in at.items():
        v, size = max(found, key=lambda f: f[0])
        if not any(p <= i and i + size <= q for p, q in safe):
            total, n = total + v, n + 1
    return math.log1p(total), math.log1p(100 * total / max(1, len(w))), n


def test_toxicity_equals_brute_force(spark):
    rng = random.Random(41)
    stems = ["zwomp", "blargh", "krutz"]
    base = ["".join(rng.choice("aeionrstld") for _ in range(rng.randrange(2, 8))) for _ in range(300)]
    rows = []
    for i in range(400):
        w = rng.choices(base, k=rng.randrange(20, 60))
        if i % 3 == 0:
            for k in rng.sample(range(len(w)), 3):
                w[k] = rng.choice(stems) + rng.choice(["", "ing", "enter", "ka"])
        elif i % 37 == 5:
            w[4:6] = ["good", "zwompka"]
        rows.append((i, " ".join(w), int(i % 3 == 0)))
    # Copies of one toxic text whose rare words are no terms, and texts of several labels or rows.
    rows += [(1000 + i, "one and the same text with onlyhere inside", 1) for i in range(9)]
    docs = spark.createDataFrame([*[(i, t) for i, t, _ in rows], (None, "zwomp"), (0, rows[0][1])], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(1, 1), (None, 1), (7777, 1)], "doc_id long, toxic int")
    known = [(t.split(), max(y, int(i == 1))) for i, t, y in rows]
    lexicon = toxicity.fit(docs, labels)
    weights, phrases = slow_lexicon(known)
    assert lexicon.weights == pytest.approx(weights) and set(lexicon.exceptions) == phrases
    assert " good zwompka " in phrases and len(weights) >= 3 and not any("onlyhere" in t for t in weights)
    x = np.array([slow_matches(w, weights, phrases)[:2] for w, _ in known])
    m, y, c = np.column_stack([np.ones(len(x)), x]), np.array([y for _, y in known]), np.array(lexicon.curve)
    # At the optimum the slope of the penalised likelihood is zero.
    assert np.abs(m.T @ (y - 1 / (1 + np.exp(-m @ c))) - 0.01 * c).max() < 1e-5
    got = {r.doc_id: r for r in toxicity.scores(docs, lexicon).collect()}
    for i, t, _ in rows:
        u, v, n = slow_matches(t.split(), weights, phrases)
        assert got[i].n_matches == n and got[i].score == pytest.approx(1 / (1 + math.exp(-(c @ [1, u, v]))))
        assert got[i].predicted == (got[i].score >= 0.7)


def test_toxicity_of_one_id_with_many_texts_is_bounded(spark):
    docs = spark.range(5000).selectExpr("id % 2 AS doc_id", "concat('some words ', if(id % 2 = 0, 'blarg ', ''), id) AS text", "'x' AS _s", "1 AS score")
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, toxic int")
    assert toxicity.training_rows(docs, labels, 100, F.lit(False), "doc_id", "text").count() == 2
    long = spark.createDataFrame([(1, "word " * 400_000), (2, "")], "doc_id long, text string")
    assert [r.n_matches for r in toxicity.scores(long, toxicity.Lexicon({" word ": 3.0})).orderBy("doc_id").collect()] == [400_000, 0]


def test_folding():
    for dressed, plain in (("ꜱнɪт", "shit"), ("I\u200bD\u00adiot", "idiot"), ("🅸🅳🅸🅾🆃", "idiot"), ("b̶a̶d̶", "bad"), ("Größe CAFÉ", "grösse café"), ("ｆｕｌｌ", "full"), ("𝓼𝓬𝓻𝓲𝓹𝓽", "script"), ("1d10t", "idiot"), ("5 or 10 days", "5 or 10 days"), ("", ""), ("\u0301\u0301", "")):
        assert " ".join(toxicity.fold(dressed).split()) == plain


def slow_base(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    c, inside = Counter(zip(w, w[1:], w[2:], strict=False)), set()
    for i in range(len(w) - 2):
        if c[tuple(w[i : i + 3])] > 1:
            inside |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(inside)


def test_counts_of_any_size_are_kept(tmp_path):
    keys = np.array([3, 9, 1 << 63], np.uint64)
    for counts in ([1, 2, 3], [1, 1 << 40, (1 << 62) + 1]):
        n = np.array(counts, np.int64)
        assert [x.tolist() for x in hashstore.unpack(hashstore.pack(keys, n, n + 1), 2)] == [keys.tolist(), counts, [c + 1 for c in counts]]
        hashstore.write_arrays(f"{tmp_path}/x", keys, n.astype(hashstore.width_of(n)))
        assert [x.tolist() for x in hashstore.map_arrays(f"{tmp_path}/x", 3, ["<u8", hashstore.COUNT])] == [keys.tolist(), counts]


def slow_discounts(counts):
    """Chen and Goodman's D1, D2, D3+; half of the count where they are out of bounds."""
    n1, n2, n3, n4 = (sum(c == k for c in counts) for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    d = [1 - 2 * y * n2 / n1 if n1 else 0.0, 2 - 3 * y * n3 / n2 if n2 else 0.0, 3 - 4 * y * n4 / n3 if n3 else 0.0]
    return [x if 0 < x < k else k / 2 for k, x in zip((1, 2, 3), d, strict=True)]


def slow_spelling(texts, order):
    """The same model over plain dictionaries."""
    top = defaultdict(int)
    for t in texts:
        for w in t.split():
            s = "\v" + w + "\f"
            for i in range(1, len(s)):
                top[s[max(0, i - order + 1) : i + 1]] += 1
    levels = {order: {g: c for g, c in top.items() if len(g) == order}}
    for n in range(order - 1, 0, -1):
        now = defaultdict(int)
        for g in levels[n + 1]:
            now[g[1:]] += 1
        for g, c in top.items():
            if len(g) == n:
                now[g] += c
        levels[n] = dict(now)
    model = {}
    for n, grams in levels.items():
        d = slow_discounts(grams.values())
        total, spare = defaultdict(int), defaultdict(float)
        for g, c in grams.items():
            total[g[:-1]] += c
            spare[g[:-1]] += min(d[min(c, 3) - 1], c)
        model[n] = ({g: (c - min(d[min(c, 3) - 1], c)) / total[g[:-1]] for g, c in grams.items()}, {x: spare[x] / total[x] for x in total})
    letters = len(levels[1])

    def log_perplexity(t):
        score = letters_seen = 0
        for w in t.split():
            s = "\v" + w + "\f"
            for i in range(1, len(s)):
                p = 1 / (letters + 1)
                for n in range(1, order + 1):
                    if n - 1 <= i:
                        g = s[i - n + 1 : i + 1]
                        p = model[n][0].get(g, 0.0) + model[n][1].get(g[:-1], 1.0) * p
                score += math.log10(p)
                letters_seen += 1
        return -score / letters_seen

    return log_perplexity


def test_quality_equals_brute_force(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["und", "der", "zeit", "lang", "heim", "weg"]) + rng.choice("aeiou") for _ in range(rng.randrange(55, 120))) for _ in range(40)]
    texts += [" ".join("QX#Z%" + rng.choice("ABC") + str(rng.randrange(99)) for _ in range(80)) for _ in range(3)]
    texts.append(" ".join("\x01ab\x02 \x01" for _ in range(9)) + " " + texts[0])
    rows = [(i, t, None if i % 9 == 0 else "de") for i, t in enumerate(texts)] + [(100, None, "de"), (101, "", "fr"), (102, "a\nb\na\n\n \na b c a b c", None), (None, texts[0], "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    r = {x.doc_id: x for x in quality.judged(docs).collect()}
    assert len(r) == len(rows)
    for lang in ("de", None):
        own = [t for _, t, x in rows if x == lang and t and slow_base(t)[0] >= 50 and 2 * slow_base(t)[4] <= slow_base(t)[0]]
        ppl = slow_spelling(own, quality.ORDER)
        for i, t, x in rows:
            if x == lang and t and t.split():
                assert r[i].log_perplexity == pytest.approx(ppl(t), rel=1e-9)
    for i, t, _ in rows:
        x = r[i]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == slow_base(t)
        assert x.base_failed == (x.n_words < 50 or 100 * x.n_repeat_words > 50 * x.n_words) and not (x.base_failed and x.kept)
    assert not any(r[i].kept for i in (41, 42)) and sum(x.kept for x in r.values()) >= 35
    assert quality.judged(docs.limit(0)).count() == 0


def slow_word_order(rows, at):
    """log10 perplexity of row ``at`` by pairs of words of all other rows; discounts are those of all."""
    tokens = [[None, *((x, w) for w in re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())), (x, "\n")] for _, t, x in rows]
    pairs = [list(zip(t, t[1:], strict=False)) for t in tokens]
    every = Counter(p for own in pairs for p in own)
    d_pair = slow_discounts(every.values())
    d_word = slow_discounts(Counter(w for _, w in every).values())
    c = Counter(p for i, own in enumerate(pairs) if i != at for p in own)
    total, spare = Counter(), Counter()
    for (v, _), n in c.items():
        total[v] += n
        spare[v] += d_pair[min(n, 3) - 1]
    before = Counter(w for _, w in c)
    rest = sum(d_word[min(n, 3) - 1] for n in before.values()) / len(c) if c else 1.0
    score = 0.0
    for v, w in pairs[at]:
        p = (before[w] - d_word[min(before[w], 3) - 1] if before[w] else 0.0) / max(len(c), 1) + rest / (len({w for _, w in every}) + 1)
        if total[v]:
            p = (c[v, w] - d_pair[min(c[v, w], 3) - 1] if c[v, w] else 0.0) / total[v] + spare[v] / total[v] * p
        score += math.log10(p)
    return -score / len(pairs[at])


def test_word_order_is_judged(spark):
    rng = random.Random(12)
    parts = ("ren", "lis", "mon", "tar", "del", "gus", "Vin", "pol")
    vocabulary = [a + b + c for a in ("la", "ne", "so", "mi", "tu") for b in parts for c in parts]
    after = {w: rng.sample(vocabulary, 3) for w in vocabulary}

    def told(n):
        w = [rng.choice(vocabulary)]
        while len(w) < n:
            w.append(rng.choice(after[w[-1]]))
        return w

    texts = [" ".join(told(rng.randrange(55, 150))) for _ in range(60)]
    for _ in range(3):
        w = told(140)
        rng.shuffle(w)
        texts.append(" ".join(w))
    rows = [(i, t, "xx") for i, t in enumerate(texts)] + [(100, texts[0], "xx"), (101, texts[1], None), (102, None, "xx"), (103, "once alone", "yy"), (104, "", None), (None, texts[2], "xx"), (7, " ".join(told(60)), "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = quality.judged(docs).collect()
    got = defaultdict(list)
    for r in out:
        got[r.doc_id].append(r)
    for at, (i, _, _) in enumerate(rows):
        want = slow_word_order(rows, at)
        assert any(r.word_log_perplexity == pytest.approx(want, rel=1e-9) for r in got[i])
    # The same words in another order: nothing in their spelling tells them.
    assert len(out) == len(rows) and not any(got[i][0].kept or got[i][0].base_failed for i in (60, 61, 62))
    assert all(got[i][0].lower_bound <= got[i][0].log_perplexity <= got[i][0].upper_bound for i in (60, 61, 62))
    assert sum(got[i][0].kept for i in range(60)) >= 55


def test_any_number_of_letters_can_be_counted(spark):
    words = ["".join(map(chr, range(a, a + 7))) for a in range(0x3400, 0x3400 + 90_000, 6) if not 0xD7F0 < a < 0xE010]
    grams, n = quality.counted({w: 1 + i % 3 for i, w in enumerate(words)})
    want = Counter()
    for i, w in enumerate(words):
        s = quality.BEGIN + w + quality.END
        for j in range(1, len(s)):
            want[s[max(0, j - quality.ORDER + 1) : j + 1]] += 1 + i % 3
    assert len({c for w in words for c in w}) > 1 << 16 and dict(zip(grams, n.tolist(), strict=True)) == want
    many = spark.createDataFrame([(i, " ".join(words[i :: 150]), f"language {i}") for i in range(150)] + [(900, "long " * 500_000, "long")], "doc_id long, text string, lang string").withColumn("n_words", F.lit("own")).withColumn("id", F.lit(1))
    rows = quality.judged(many).collect()
    assert len(rows) == 151 and all(r.n_words >= 90 for r in rows)


def shuffle_files(spark):
    names = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {x for x in names.split("\n") if "shuffle_" in x}


def test_quality_leaves_no_intermediate_files(spark):
    setting = spark.conf.get(common.FREE_SHUFFLES, None)
    docs = spark.createDataFrame([(i, " ".join(f"word{(i * k) % 71}" for k in range(60 + i)), "xx") for i in range(40)], "doc_id long, text string, lang string")
    own = common.own_dir(spark)
    before, there = shuffle_files(spark), set(os.listdir(own)) if os.path.isdir(own) else set()
    rows = quality.judged(docs)
    for _ in range(50):  # Spark deletes in the background
        if not shuffle_files(spark) - before:
            break
        time.sleep(0.2)
    left = {x.rpartition("-")[0] for x in set(os.listdir(own)) - there}
    assert not shuffle_files(spark) - before and {"lm", "spelling", "measured"} <= left and not {"counts", "model"} & left
    assert spark.conf.get(common.FREE_SHUFFLES, None) == setting and rows.count() == 40 == len(rows.collect())


def test_model_is_asked_once_for_an_ngram(spark, monkeypatch):
    rng = random.Random(3)
    plain = ["".join(rng.choice("abcde\x00\u00e9\uffff") for _ in range(rng.randrange(1, 9))) for _ in range(400)]
    wide = ["".join(rng.choice("ab\U0001f600\U0010ffff") for _ in range(rng.randrange(1, 7))) for _ in range(60)]
    texts = [" ".join(rng.sample(plain, 70)) for _ in range(20)] + [" ".join(rng.sample(plain + wide, 70)) for _ in range(5)]
    s = quality.Speller(quality.write_model(spark.createDataFrame([(t, "xx") for t in texts], "text string, lang string")))
    ppl = slow_spelling(texts, quality.ORDER)
    asked = []
    for table in (s.shares, s.left):
        monkeypatch.setattr(table, "find", lambda keys, *d, f=table.find: asked.append(len(keys)) or f(keys, *d))

    def right(words):
        logs, letters = s.word_scores([w.encode() for w in words], "xx")
        assert letters.tolist() == [len(w) + 1 for w in words]
        assert (-logs / letters).tolist() == pytest.approx([ppl(w) for w in words], rel=1e-9)

    right(plain[:300])
    first = sum(asked)
    right(plain[299::-1])
    assert first and sum(asked) == first
    right(plain[200:] + wide)  # letters beyond 16 bits: not kept
    right(plain[250:])
    s.known.clear()
    monkeypatch.setattr(quality, "HELD_GRAMS", 10)
    right(plain)
    assert not s.known


def test_language_model_equals_brute_force(spark, docs):
    model = lm.train(docs.where(~lm.held_out_fold(F.col("doc_id"))))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    uni, bi = Counter(), Counter()
    for i, t in rows:
        if not held(i):
            uni.update(tokens(t))
            bi.update(zip([0, *tokens(t)[:-1]], tokens(t), strict=True))
    n, v = sum(uni.values()), len(uni)
    before = Counter(b for _, b in bi)
    d2, d1 = slow_discounts(bi.values()), slow_discounts(before.values())
    behind, total = defaultdict(lambda: [0, 0, 0]), Counter()
    for (a, _), c in bi.items():
        behind[a][min(c, 3) - 1] += 1
        total[a] += c
    rest = sum(d1[min(c, 3) - 1] for c in before.values()) / len(bi)
    off = lambda d, c: d[min(c, 3) - 1] if c else 0.0
    low = lambda w: (before[w] - off(d1, before[w])) / len(bi) + rest / (v + 1)

    def p(a, w):
        if a not in total:
            return low(w)
        return (bi[a, w] - off(d2, bi[a, w])) / total[a] + sum(x * y for x, y in zip(d2, behind[a], strict=True)) / total[a] * low(w)

    got = sorted(((-1 if r.doc_id is None else r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in lm.scores(docs, model).collect())
    want = []
    for i, t in rows:
        w = tokens(t)
        want.append((-1 if i is None else i, len(w), sum(x in uni for x in w), n, round(sum(math.log10((uni[x] + 1) / (n + v + 1)) for x in w), 6), round(sum(math.log10(p(a, b)) for a, b in zip([0, *w[:-1]], w, strict=True)), 6)))
    assert got == sorted(want)
    assert sum(p(0, w) for w in uni) + (1 - sum(p(0, w) for w in uni)) == pytest.approx(1) and sum(low(w) for w in uni) + rest / (v + 1) == pytest.approx(1)
    groups = lm.train(docs.where(~lm.held_out_fold(F.col("doc_id"))), key_bits=17)
    assert groups.numbers.groups > 2, groups.numbers
    assert sorted(((-1 if r.doc_id is None else r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in lm.scores(docs, groups).collect()) == got
    none = lm.train(docs.limit(0))
    assert {r.score for r in lm.scores(docs, none).collect()} == {0.0} and lm.scores(docs.limit(0), model).count() == 0


def slow_features(lang, source, n_chars, t):
    """The features of one document by their description, as numbers of steps."""
    t = t or ""
    raw, grams = t.encode(), Counter()
    for i in range(len(raw) - 2):
        h = (raw[i] * 0x9E3779B1 ^ raw[i + 1] * 0x85EBCA6B ^ raw[i + 2] * 0xC2B2AE35) & 0xFFFFFFFF
        grams[(h * 0x27D4EB2F & 0xFFFFFFFF) >> 23] += 1
    n, chars, symbols, dup, repeat = slow_base(t)
    log = lambda v: min(1.0, math.log2(1 + v) / 24)
    lines = [len(x) for x in t.split("\n")]
    out = [math.sqrt(grams[g] / max(1, grams.total())) for g in range(512)]
    out += [log(n), log(chars / max(1, n)), symbols / max(1, chars), dup / len(lines), repeat / max(1, n), min(1.0, n / 200)]
    out += [float(xxhash.xxh32_intdigest(f"{source is None}{source}") % 64 == i) for i in range(64)]
    out += [float(xxhash.xxh32_intdigest(f"{lang is None}{lang}") % 16 == i) for i in range(16)]
    out += [sum(min(31, int(2 * math.log2(1 + x))) == i for x in lines) / len(lines) for i in range(32)]
    out += [float(n_chars is None), log(max(0, n_chars or 0)), log(len(lines)), log(max(lines)), log(sum(lines) / len(lines))]
    return out


def slow_fit(x, y):
    """Ridge-penalised logistic regression over scaled columns, by plain Newton steps."""
    mean, scale = x.mean(0), x.std(0)
    scale[scale <= 1e-6] = 1
    m, w = np.hstack([np.ones((len(x), 1)), (x - mean) / scale]), np.zeros(x.shape[1] + 1)
    ridge = np.diag([1e-6] + [1.0] * x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(m @ w, -30, 30)))
        w = w - np.linalg.lstsq((m.T * (p * (1 - p) + 1e-9)) @ m + ridge, m.T @ (p - y) + ridge @ w, rcond=None)[0]
    return lambda v: np.clip(np.hstack([np.ones((len(v), 1)), (v - mean) / scale]) @ w, -30, 30)


def quality_corpus(spark, n=900):
    rng = random.Random(77)
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        w = ["".join(rng.choice("aeionrst" if good else "qxzkvwrst") for _ in range(rng.randrange(2, 8))) for _ in range(rng.randrange(5, 40))]
        gap = rng.randrange(6, 12) if good else rng.randrange(1, 4)
        rows.append((i, "\n".join(" ".join(w[k : k + gap]) for k in range(0, len(w), gap)), rng.choice(["en", None]), rng.choice(["a", "b"]), 7, "x"))
        if i < 260:
            labels.append((i, int(good)))
    rows += [(n, None, None, None, None, "x"), (n + 1, "", "en", "a", -5, "x"), (None, "no id", None, None, None, None), rows[-1], rows[300], (2, "another text of a labelled id", "en", "a", 3, "y")]
    rows += [(2000 + i, rows[301][1], "en", "b", 7, "z") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")
    return docs, spark.createDataFrame([*labels, (3, 0), (4, 2), (5, None), (None, 1)], "doc_id long, quality int")


def test_quality_features(spark):
    docs, _ = quality_corpus(spark, 320)
    got = Counter((r.id, bytes(r.x)) for r in cotrain.features(docs).collect())
    want = Counter((r.doc_id, bytes(round(255 * v) for v in slow_features(r.lang, r.source, r.n_chars, r.text))) for r in docs.collect())
    near = lambda a, b: a[0] == b[0] and max(abs(x - y) for x, y in zip(a[1], b[1], strict=True)) <= 1
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert all(near(a, b) for a, b in zip(sorted(got.elements(), key=key), sorted(want.elements(), key=key), strict=True))


def test_cotraining_equals_brute_force(spark):
    docs, labels = quality_corpus(spark)
    table = cotrain.features(docs)
    rounds, handed = 3, 12
    model = cotrain.fit(table, labels, rounds=rounds, handed=handed)
    r = table.collect()
    x = {id(v): np.frombuffer(v.x, np.uint8) / 255 for v in r}
    view = lambda v, k: x[id(v)][: cotrain.N_TEXT] if k == 0 else x[id(v)][cotrain.N_TEXT :]
    y = {}
    for v in labels.collect():
        if v.doc_id is not None and v.quality in (0, 1):
            y[v.doc_id] = max(v.quality, y.get(v.doc_id, 0))
    crc = lambda i: zlib.crc32(str(i).encode()) % 5
    own = [min((v for v in r if v.id == i), key=lambda v: (v.sha, v.x)) for i in sorted(y) if crc(i) != 3]
    train, aside = [v for v in own if crc(v.id) != 1], [v for v in own if crc(v.id) == 1]
    named = {v.doc_id for v in labels.collect()} - {None}
    pool = {}
    for v in r:
        if v.id not in named:
            pool.setdefault(v.sha, []).append(v)
    xs = [[view(v, k) for v in train] for k in (0, 1)]
    ys = [[y[v.id] for v in train] for k in (0, 1)]
    share, given = sum(ys[0]) / len(ys[0]), [set(), set()]
    fitted = lambda: [slow_fit(np.array(a), np.array(b)) for a, b in zip(xs, ys, strict=True)]
    truth = np.array([y[v.id] for v in aside])
    for _ in range(rounds):
        models, picks = fitted(), []
        for taker in (0, 1):
            m = models[1 - taker]
            curve = slow_fit(m(np.array([view(v, 1 - taker) for v in aside]))[:, None], truth)
            p = {s: [round(1 / (1 + math.exp(-curve(m(view(v, 1 - taker)[None])[:, None])[0])), 4) for v in vs] for s, vs in pool.items() if s not in given[taker]}
            quota = [max(1, round(handed * (1 - share))), max(1, round(handed * share))]
            best = [[s for q, s in sorted((-max(q if label else 1 - q for q in v), s) for s, v in p.items()) if -q >= 0.95][: quota[label]] for label in (0, 1)]
            part = min(len(b) / q for b, q in zip(best, quota, strict=True))
            picks += [(taker, s, label) for label in (0, 1) for s in best[label][: int(part * quota[label])]]
        for taker, s, label in picks:
            xs[taker].append(view(min(pool[s], key=lambda v: v.x), taker))
            ys[taker].append(label)
            given[taker].add(s)
    assert max(map(len, given)) == rounds * handed
    models = fitted()
    z = [m(np.array([view(v, k) for v in aside])) for k, m in enumerate(models)]
    curves = [slow_fit(q[:, None], truth) for q in z]
    both = slow_fit(np.column_stack([c(q[:, None]) for c, q in zip(curves, z, strict=True)]), truth)
    t, m = (c(f(np.array([view(v, k) for v in r]))[:, None]) for k, (c, f) in enumerate(zip(curves, models, strict=True)))
    want = sorted((str(v.id), round(1 / (1 + math.exp(-s)), 4)) for v, s in zip(r, both(np.column_stack([t, m])), strict=True))
    got = sorted((str(v.doc_id), round(v.score, 4)) for v in cotrain.scores(table, model).collect())
    assert [i for i, _ in got] == [i for i, _ in want] and max(abs(a - b) for (_, a), (_, b) in zip(got, want, strict=True)) < 2e-3
    good = {v.doc_id: v.text for v in docs.collect()}
    right = [(v.score >= 0.5) == ("q" not in good[v.doc_id] and "z" not in good[v.doc_id]) for v in cotrain.scores(table, model).collect() if v.doc_id is not None and 260 <= v.doc_id < 900]
    assert sum(right) > 0.95 * len(right)


def test_long_texts_and_clashing_columns(spark):
    long = spark.createDataFrame([(1, "a b " * 400_000, 1, "x"), (2, None, 2, "y")], "doc_id long, text string, score int, n_tokens string")
    model = lm.train(long)
    r = {x.doc_id: x for x in lm.scores(long, model).collect()}
    assert r[1].n_tokens == 800_001 and r[1].score > -1000 and r[2].n_tokens == 1
    page = spark.createDataFrame([(1, "u", "é" * 2_000_000, "own", 7), (2, "v", "é" * 2_000_000, "own", 7)], "page_id long, url string, html string, sha string, best long")
    got = {x.page_id: (x.record_type, x.payload_bytes, x.error) for x in warc.round_trip(spark, page).collect()}
    assert got == {1: ("revisit", 4_000_000, None), 2: ("response", 4_000_000, None)}


def test_archives_of_two_attempts_do_not_mix(spark):
    folder = scratch(spark, "warc-twice")
    p = pages(spark)
    first, second = (warc.write_archives(p, folder) for _ in range(2))
    assert not {r.file for r in first.collect()} & {r.file for r in second.collect()}
    assert warc.read_archives(first).count() == warc.read_archives(second).count() == p.count()
    body = b"HTTP/1.1 200 OK\r\nX: " + b"y" * (2 << 20)
    bad = warc.record("response", 1, "u", "A", 5, body, "2020-01-01T00:00:00Z")
    assert list(warc.Reader(io.BytesIO(bad)))[0]["error"] == "the HTTP header doesn't end"


def test_pairs_of_one_id_are_told_apart(spark):
    t = spark.createDataFrame([(i, 0, "user", f"text {i}") for i in range(1, 5)], "conv_id long, turn long, role string, text string")
    p = spark.createDataFrame([(7, 1, 2), (7, 3, 4), (7, 1, 2)], "pair_id long, chosen_id long, rejected_id long")
    r = chat.format_preferences(t, p).collect()
    assert sorted((x.pair_id, x.chosen_id, x.rejected_id) for x in r) == [(7, 1, 2), (7, 3, 4)]
    assert all(f"text {x.chosen_id}" in x.chosen and f"text {x.rejected_id}" in x.rejected for x in r)


def test_the_shared_folder_is_named_off_local_mode():
    def session(master, given=None):
        option = SimpleNamespace(isDefined=lambda: given is not None, get=lambda: given)
        context = SimpleNamespace(master=master, applicationId=master, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: option)))
        return SimpleNamespace(conf={}, sparkContext=context)

    for dir_of in (common.shared_dir, store.shared_dir):
        with pytest.raises(ValueError):
            dir_of(session("spark://host:7077"))
        assert dir_of(session("yarn", "hdfs://x/y/")) == "hdfs://x/y"
        assert "tessera-" in dir_of(session("local[2]"))


def test_cotraining_odd_cases(spark, docs):
    table = cotrain.features(docs.withColumn("x", F.lit("own")).withColumn("sha", F.lit(1)))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    model = cotrain.fit(table, labels)
    r = cotrain.scores(table, model).collect()
    assert len(r) == docs.count() and all(0 <= x.score <= 1 for x in r)
    empty = cotrain.fit(table, labels.limit(0))
    assert {x.score for x in cotrain.scores(table, empty).collect()} == {0.5} and cotrain.scores(cotrain.features(docs.limit(0)), model).count() == 0
    long = spark.createDataFrame([(1, "word\n" * 300_000), (2, "x" * 2_000_000)], "doc_id long, text string")
    assert cotrain.scores(cotrain.features(long), model).count() == 2
    many = spark.range(5000).selectExpr("id % 2 AS doc_id", "concat('text ', id) AS text")
    two = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, quality int")
    assert cotrain.fit(cotrain.features(many), two).share in (0.0, 0.5, 1.0)
