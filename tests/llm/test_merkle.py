"""The Merkle manifest against a plain Python tree."""
import collections
import hashlib
import zlib

import pytest

from quillscan.llm import merkle

LOWER = {c: c + 32 for c in range(65, 91)}


def digest(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return digest("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row)


def climb(levels, at, folded):
    siblings = []
    for level in levels[:-1]:
        run = level[at // 8 * 8:at // 8 * 8 + 8]
        siblings += run[:at % 8] + run[at % 8 + 1:]
        folded = digest(run[:at % 8] + [folded] + run[at % 8 + 1:])
        at //= 8
    return folded, siblings


def build(hashes):
    levels = [hashes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([digest(last[i:i + 8]) for i in range(0, len(last), 8)])
    return levels


def manifest(rows):
    """(doc_id, source, lang, n_chars, text) rows -> the rows of the result."""
    by_lang = collections.defaultdict(list)
    for r in rows:
        by_lang[r[2]].append((r[0] is not None, r[0] or 0, leaf(r), r))
    order = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: (sorted(by_lang[x], key=lambda e: e[:3])) for x in order}
    built = {x: build([e[2] for e in trees[x]]) for x in order}
    top = build([built[x][-1][0] for x in order])
    root = top[-1][0] if order else None
    out = []
    for t, x in enumerate(order):
        for at, (_, _, h, r) in enumerate(trees[x]):
            start = h
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
                start = leaf(r[:4] + (r[4].translate(LOWER),))
            folded, low = climb(built[x], at, start)
            folded, high = climb(top, t, folded)
            out.append((r[0], h, built[x][-1][0], root, digest(low + high), folded, folded == root))
    return sorted(out, key=repr)


def audit(make, rows):
    got = merkle.audit(make(rows, "doc_id long, source string, lang string, n_chars long, text string"))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


def test_odd_rows_and_many_languages(make, monkeypatch):
    monkeypatch.setattr(merkle, "CHUNK", 16)  # several chunks a tree, and chunks over several trees
    rows = [(i, f"src{i % 5}", "en", i * 7, f"Text {i} É") for i in range(150)]
    rows += [(1000 + i, None, f"l{i:02}", None, None if i % 3 else f"ABC {i}") for i in range(20)]
    rows += [(2000 + i, "s", None, 3, "") for i in range(9)] + [(3000 + i, "s", "", 3, "Ü z") for i in range(8)]
    rows += [(None, "s", "en", 1, "No Id"), (None, None, None, None, None), (5, "src0", "en", 35, "Text 5 É"),
             (7, "other", "en", 1, "same id"), (8, "s", "zz", 9, "A" * 300_000), (-6, "s", "é", 1, "Ab")]
    rows += [(4000, "s", "hot", 1, "Copy")] * 70
    assert audit(make, rows) == manifest(rows)


@pytest.mark.parametrize("rows", [
    [], [(3, "s", "en", 1, "Alone")], [(3, "s", "en", 1, "A"), (4, "s", "de", 1, "B")],
    [(i, "s", "en", 1, "T") for i in range(8)], [(i, "s", "en", 1, "T") for i in range(9)]])
def test_small_tables(make, rows):
    assert audit(make, rows) == manifest(rows)


def test_some_paths_break(make):
    rows = [(i, "s", "en", 1, "Upper" if i % 2 else "lower") for i in range(100)]
    verified = {r[0]: r[-1] for r in audit(make, rows)}
    for i, ok in verified.items():
        assert ok == (i % 2 == 0 or zlib.crc32(str(i).encode()) % 3 != 0)
