"""PII, language ID, packing and SimHash against brute force, on whole small tables and odd rows."""
import collections
import hashlib
import re
import tracemalloc
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from llm_data import ODD_TEXTS, SF
from pyspark.sql import functions as F

from quillscan.llm import langid, packing, pii, queries, simhash

VOCABULARY = queries.vocabulary("word_bpe_49k.json")


def documents():
    return duckdb.sql(f"select doc_id, text, lang from '{SF}/documents.parquet' order by doc_id").fetchall()


# ------------------------------------------------------------------ PII

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    s = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d)))
    return s % 10 == 0


def base_spans(text):
    out = []
    for kind, p in BASE.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind != "ip" or all(int(x[-4:]) <= 255 and int(x[:-4] or 0) == 0 for x in m[0].split(".")),
                  "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def check_pii(rows, got):
    want = collections.Counter()
    for doc_id, text in rows:
        s = base_spans(text)
        n = collections.Counter(k for k, _, _ in s)
        want[(doc_id, *[n[k] for k in BASE], hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in s).encode()).hexdigest())] += 1
    assert collections.Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == want
    for r in got:
        spans = [x.split(":") for x in r.spans.split(",") if x]
        assert spans == sorted(spans, key=lambda x: (list(BASE).index(x[0]), int(x[1])))
        assert len(spans) == r.n_email + r.n_ip + r.n_card + r.n_phone + r.n_found


def test_pii_whole_table(spark):
    check_pii([r[:2] for r in documents()], queries.op1_pii(spark, SF).collect())


def test_pii_odd_rows(make):
    rows = [r for r in ODD_TEXTS if r[0] not in (16, 17)]  # Python's own expressions are slow on these
    check_pii(rows, pii.report(make(rows, "doc_id long, text string")).collect())
    assert pii.report(make([], "doc_id long, text string")).collect() == []
    assert len(pii.report(make(ODD_TEXTS, "doc_id long, text string")).collect()) == len(ODD_TEXTS)


def test_pii_learns_from_context(make):
    rows = [(i, f"please write to user{i}@mail.example.com today") for i in range(9)]
    rows += [(100, "please write to joe99123 today"), (101, "we saw joe99123 there"), (102, "we saw 12 there")]
    got = {r.doc_id: r.spans for r in pii.report(make(rows, "doc_id long, text string")).collect()}
    assert got[100] == "email:16:24" and got[101] == "email:7:15" and got[102] == ""


def test_pii_learns_grouped_numbers(make):
    """Whole phones and cards are instances, also unseen ones of several words."""
    rows = [(i, f"you may call me at +1 (52{i}) 555-10{i}5 now") for i in range(7)]
    cards = ["4111 1111 1111 1111", "5500 0000 0000 0004", "3400 0000 0000 009", "6011 0000 0000 0004", "4012 8888 8888 1881", "5105 1051 0510 5100"]
    rows += [(20 + i, f"the bill goes to {c} as ever") for i, c in enumerate(cards)]
    rows += [(100, "you may call me at (743) 555-3824, or at noon"), (101, "he wrote (743) 555-3824 on it"), (102, "it has 555-3824 pages"),
             (103, "the bill goes to 4111 1111 1111 1112 as ever"), (104, "room 15215551015, floor 12"), (105, "in 2020 2021 to me at x")]
    got = {r.doc_id: r.spans for r in pii.report(make(rows, "doc_id long, text string")).collect()}
    assert got[100] == "phone:19:33" and got[101] == "phone:9:23" and got[102] == "" and got[105] == ""
    assert got[103] == "card:17:36" and got[104] == "phone:5:16"
    assert [got[i] for i in range(7)] == ["phone:19:36"] * 7 and [got[20 + i].split(":")[0] for i in range(6)] == ["card"] * 6


def test_pii_context_and_rounds(make):
    """A context reaches over numbers and long words, and what only a fourth round reaches is found."""
    rows = [(i, f"ticket 55{i} user{i}@mail.example.com") for i in range(20)] + [(100, "ticket 777 joe99123")]
    rows += [(20 + i, f"{'w' * 90} at desk{i}@mail.example.com") for i in range(20)] + [(101, f"{'w' * 90} at ann99123, {'v' * 90} at bob99123")]
    chain = [[f"{'s' * (k + 1)}{10000 + j}{'@mail.example.com' * (k == 0)}" for j in range(n)] for k, n in enumerate((1300, 220, 37, 7, 1))]
    rows += [(200 + k, " ".join(f"send mail{'abcd'[k]} to {x}" for x in chain[k] + chain[k + 1])) for k in range(4)]
    got = {r.doc_id: r for r in pii.report(make(rows, "doc_id long, text string")).collect()}
    assert got[100].spans == "email:11:19" and got[101].spans == "email:94:102"
    assert [got[200 + k].n_found for k in range(4)] == [220, 220 + 37, 37 + 7, 7 + 1]
    assert got[203].n_email == 0


def test_pii_redact(make):
    docs = make([(1, "a b@c.de é +1 (743) 555-3824!", 5), (2, None, None), (3, "plain", 7)], "doc_id long, text string, n_chars long")
    got = pii.redact(docs)
    assert got.columns == docs.columns
    assert {r.doc_id: (r.text, r.n_chars) for r in got.collect()} == {1: ("a [EMAIL] é [PHONE]!", 20), 2: (None, None), 3: ("plain", 7)}


# ------------------------------------------------------------------ language ID

def test_language_held_out(spark):
    lang = {d: x for d, _, x in documents()}
    text = {d: t for d, t, _ in documents()}
    got = queries.op5_language(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(lang)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text[r.doc_id] or ""))
    known = [r for r in got if r.held_out and lang[r.doc_id] and r.lang_pred != "und"]
    assert sum(r.lang_pred == lang[r.doc_id] for r in known) / len(known) >= 0.97


def test_language_vectors():
    codes, counts = langid.ngrams("Ab, aB!")
    assert counts.sum() == 5  # _ab, ab_, b_a, _ab, ab_
    plain = sum(c * np.prod([langid._letter_vector(int(code >> (21 * (2 - k))) & 0x1FFFFF, 2 - k, 256).astype(int) for k in range(3)], axis=0)
                for code, c in zip(codes, counts))
    assert np.array_equal(langid._Bundler(256)(codes, counts), plain)
    small = langid._Bundler(64)
    texts = ["".join(chr(97 + (i * j) % 26) for i in range(300)) for j in range(1, 9)]
    fresh = [langid._Bundler(64)(*langid.ngrams(t)) for t in texts]
    assert all(np.array_equal(small(*langid.ngrams(t)), f) for t, f in zip(texts, fresh))


def test_language_counts_hold_few_texts():
    """The n-grams of a batch's texts are added up as they come, not held side by side."""
    rng = np.random.default_rng(0)
    words = ["".join(map(chr, rng.integers(97, 123, 6))) for _ in range(3000)]
    texts = [" ".join(words[i] for i in rng.integers(0, 3000, 300)) for _ in range(2000)]
    tracemalloc.start()
    codes, n = langid.counted(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = collections.Counter()
    for t in texts:
        c, k = langid.ngrams(t)
        want.update(dict(zip(c.tolist(), k.tolist())))
    assert dict(zip(codes.tolist(), n.tolist())) == want
    assert peak < 25e6, peak
    assert [len(x) for x in langid.counted([])] == [0, 0]


def test_language_odd_rows(make):
    docs = make([(i, t, "en" if i else None) for i, t in ODD_TEXTS], "doc_id long, text string, lang string")
    got = langid.identify(docs).collect()
    assert len(got) == len(ODD_TEXTS) and {r.lang_pred for r in got if r.doc_id in (1, 2, 3, 11, 15, 18)} == {"und"}
    untrained = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identify(untrained).collect()} == {"und"}
    assert langid.identify(docs.limit(0)).collect() == []
    kept = langid.keep_known(docs, 0.0)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {4, 5, 6, 9}


# ------------------------------------------------------------------ packing

def check_packing(rows, got, with_ids=False):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(VOCABULARY)
    want = [(d, e.ids + [1]) for (d, _), e in zip(rows, t.encode_batch([x or "" for _, x in rows], add_special_tokens=False))]
    pieces = collections.defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
    for d, ids in want:
        if [x for x, _ in want].count(d) > 1:
            continue
        own = sorted(pieces[d], key=lambda r: r.start)
        assert sum(r.length for r in own) == len(ids) and all(r.doc_tokens == len(ids) and r.length > 0 for r in own)
        at = 0
        for r in own:
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids[at:at + r.length], "<u4").tobytes())
            at += r.length
    by_sequence = collections.defaultdict(list)
    for r in got:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    padding = 0
    for x in by_sequence.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    return padding / max(1, sum(r.length for r in got))


def test_packing_whole_table(spark):
    assert check_packing([r[:2] for r in documents()], queries.op6_packing(spark, SF).collect()) < 0.01


def test_packing_odd_rows(make):
    docs = make(ODD_TEXTS, "doc_id long, text string")
    got = packing.pack(docs, VOCABULARY).withColumn("ids_crc32", F.crc32("ids")).collect()
    check_packing(ODD_TEXTS, got)
    assert packing.pack(docs.limit(0), VOCABULARY).collect() == []
    blocks = packing.pack(docs, VOCABULARY, stream=3000).withColumn("ids_crc32", F.crc32("ids")).collect()
    check_packing(ODD_TEXTS, blocks)


def test_cheapest_cuts():
    rng = np.random.default_rng(7)
    for _ in range(60):
        window = int(rng.choice([8, 16, 64]))

        def cost(n, penalty):
            short = n & (n - 1) == 0 and (penalty == 0 or n >= window >> packing.HALVINGS)
            return min(window - n, packing.SHORT if short else window) + penalty

        pos = np.unique(np.concatenate([[0], np.cumsum(rng.integers(1, window + 1, 12))]))
        pen = np.where(rng.random(len(pos)) < 0.4, 0, rng.integers(0, 9, len(pos)))
        best = [0] + [None] * (len(pos) - 1)
        for j in range(1, len(pos)):
            best[j] = min(best[i] + cost(int(pos[j] - pos[i]), pen[j]) for i in range(j) if pos[j] - pos[i] <= window)
        cuts = packing.choose_cuts(pos, pen, window)
        assert sum(cost(int(pos[b] - pos[a]), pen[b]) for a, b in zip([0] + cuts, cuts)) == best[-1]


# ------------------------------------------------------------------ SimHash

def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    sh = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(fps, bits=2):
    """fps: [(doc_id, fp)] -> component_id of every row."""
    a = np.array([f for _, f in fps], np.uint64)
    label = np.arange(len(a))
    for i in range(len(a)):
        near = np.nonzero(np.bitwise_count(a ^ a[i]) <= bits)[0]
        old = np.unique(label[near])
        label[np.isin(label, old)] = old[0]
    least = {}
    for (d, _), x in zip(fps, label):
        if d is not None:
            least[x] = min(d, least.get(x, d))
    return [least.get(x) for x in label]


def check_groups(rows, got):
    fps = [(d, brute_fingerprint(t)) for d, t in rows]
    want = collections.Counter((d, f"{f:016x}", c) for (d, f), c in zip(fps, brute_groups(fps)))
    assert collections.Counter(tuple(r) for r in got) == want


def test_simhash_whole_table(spark):
    check_groups([r[:2] for r in documents()], queries.op9_simhash(spark, SF).collect())


def test_simhash_odd_rows(make):
    docs = make(ODD_TEXTS, "doc_id long, text string")
    got = simhash.groups(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0"), "component_id")
    check_groups(ODD_TEXTS, got.collect())
    assert simhash.groups(docs.limit(0)).collect() == []
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    fps = [(d, brute_fingerprint(t)) for d, t in ODD_TEXTS]
    names = set(brute_groups(fps))
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(n for n in names if n is not None)


@pytest.mark.parametrize("shard,block", [(40, 1 << 19), (300, 100)])
def test_simhash_many_shards(spark, shard, block):
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    flips = [seeds ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)) for _ in range(3)]
    far = flips[0] ^ (np.uint64(7) << rng.integers(0, 60, 300).astype(np.uint64))
    points = np.unique(np.concatenate([seeds, *flips, far])).view(np.int64)
    reps = spark.createDataFrame([(int(p), i) for i, p in enumerate(points)], "fp long, least_id long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(reps, 2, shard, block)).collect()}
    want = brute_groups([(i, int(p)) for i, p in enumerate(points.view(np.uint64))])
    groups = collections.defaultdict(set)
    for p, w in zip(points.tolist(), want):
        groups[w].add(roots.get(p, p))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)
