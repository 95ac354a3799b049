"""The n-gram Jaccard join against all pairs in plain Python."""
import random

import numpy as np
import pytest

from llm_data import ODD_TEXTS, SF
from quillscan.llm import ngramjoin, queries

SPACE = " \t\n\x0b\x0c\r"
LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text, size=3):
    words, word = [], ""
    for c in (text or "").translate(LOWER) + " ":
        if c in SPACE:
            words, word = words + [word] if word else words, ""
        else:
            word += c
    return {tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def brute(rows, num=9, den=10):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by_gram = {}
    for i, s in enumerate(sets):
        for g in s:
            by_gram.setdefault(g, []).append(i)
    tried = set()
    for same in by_gram.values():
        for a in same:
            for b in same:
                if a < b and (a, b) not in tried:
                    tried.add((a, b))
                    both = len(sets[a] & sets[b])
                    if both * den >= num * (len(sets[a]) + len(sets[b]) - both):
                        root[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None and sets[i]:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr)


def run(make, rows, **args):
    got = ngramjoin.groups(make(rows, "doc_id long, text string"), **args)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


def near_copies(seed):
    """Chains of texts around the threshold: single words changed, dropped or added, passages in common."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 4)))
    passage = " ".join(word() for _ in range(60))
    rows = []
    for base in range(25):
        words = [word() for _ in range(rng.choice([5, 9, 10, 11, 12, 30, 60, 200, 600]))]
        for _ in range(rng.randint(1, 14)):
            words = list(words)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 6])):
                at = rng.randrange(len(words))
                words[at:at + 1] = rng.choice([[word()], [], [words[at], word()]]) or ["x"]
            text = " ".join(words) + (" " + passage if rng.random() < 0.3 else "")
            rows.append((rng.randrange(10_000), text))
            if rng.random() < 0.2:
                rows.append((rng.randrange(10_000), text.upper().replace(" ", " \n")))
    return rows


@pytest.mark.parametrize("seed,group", [(1, ngramjoin.GROUP), (2, 500), (3, 4000)])
def test_against_all_pairs(make, seed, group):
    rows = near_copies(seed)
    assert run(make, rows, group=group) == brute(rows)


def test_odd_rows(make):
    rows = [(i, t) for i, t in ODD_TEXTS] + [(30, "two words"), (31, "Two  WORDS"), (32, "a b"), (33, "a b c d e"), (None, "two words"), (None, None)]
    rows += [(40 + i, "the same text in very many rows of the table") for i in range(120)]
    assert run(make, rows) == brute(rows)
    assert run(make, []) == []
    assert run(make, [(1, None), (2, "")]) == [(1, 0, 1), (2, 0, 2)]


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in queries.op13_ngram_join(spark, SF).collect()), key=repr)
    assert got == brute(rows)
    assert any(c != d for d, _, c in got)


@pytest.mark.parametrize("seed", range(6))
def test_trie_loses_no_link(seed):
    rng = np.random.default_rng(seed)
    sets, groups, home, query = [], [], [], []
    for g in range(4):
        base = np.sort(rng.choice(400, int(rng.integers(9, 120)), replace=False))
        for _ in range(30):
            keep = base[rng.random(len(base)) > rng.choice([0.0, 0.02, 0.06])]
            sets.append(np.unique(np.concatenate([keep, rng.choice(500, int(rng.integers(0, 4)))])).astype(np.uint64))
            groups.append(g)
            side = int(rng.integers(1, 3)) if g % 2 else 0  # a block with itself, or two blocks
            home.append(side != 2), query.append(side != 1)
    labels = ngramjoin.forest(groups, sets, home, query, 9, 10)
    want = np.arange(len(sets))
    for a in range(len(sets)):
        for b in range(len(sets)):
            if a != b and groups[a] == groups[b] and home[a] and query[b]:
                both = len(np.intersect1d(sets[a], sets[b]))
                if 10 * both >= 9 * (len(sets[a]) + len(sets[b]) - both):
                    ngramjoin._merge(want, np.array([a]), np.array([b]))
    assert (labels == want).all()
