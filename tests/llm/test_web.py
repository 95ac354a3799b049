"""WARC archives, URL rules, tool calls and the SentencePiece transducer."""
import base64
import collections
import glob
import gzip
import hashlib
import json
import random
import re

import duckdb
import pyarrow as pa
import pytest
from llm_data import ODD_TEXTS, SF
from pyspark.sql import functions as F

from quillscan.llm import queries, spwfst, toolcalls, urlfilter, warc

# ------------------------------------------------------------------ WARC


def check_warc(rows, got):
    data = [(i, (h or "").encode()) for i, _, h in rows]
    first = {}
    for i, p in data:
        if i is not None:
            first[p] = max(i, first.get(p, i))
    want = collections.Counter()
    for i, p in data:
        w = first.get(p)
        revisit = w is not None and i != w
        want[(i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if revisit else "response", w if revisit else None)] += 1
    assert collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want


def pages():
    return duckdb.sql(f"select page_id, url, html from '{SF}/pages.parquet'").fetchall()


def test_tool_levels_without_positions(spark):
    """op7_tool_calls: a null position is out of order, so that depths and cycles are found."""
    rows = [(1, "a", None, []), (1, "b", None, ["a"]), (1, "c", 3, ["b"]), (2, "x", None, ["y"]), (2, "y", 1, ["x"]), (3, "p", 1, []), (3, "q", 2, ["p"])]
    calls = spark.createDataFrame(rows, "conv_id long, call_id string, position long, after array<string>")
    got = {(r.conv_id, r.call_id): r.level for r in toolcalls.levels(calls).collect()}
    assert got == {(1, "a"): 0, (1, "b"): 1, (1, "c"): 2, (2, "x"): -1, (2, "y"): -1, (3, "p"): 0, (3, "q"): 0}


def test_warc_whole_table(spark):
    check_warc(pages(), queries.op4_warc(spark, SF).collect())


TRAPS = ["WARC/1.1\r\n", "WARC/1.1", "aWARC/1.1\r\nWARC-Type: response\r\n\r\nx", "\r\n\r\n", "\n", "\r", "x\r\n\r\nWARC/1.1\r\nWARC/1.1", "\ufeffbom"]


@pytest.mark.parametrize("chunk", [100, 1 << 16])
def test_warc_odd_rows(make, spark, tmp_path, chunk):
    rows = [(i, f"http://h/{i}\r\nWARC/1.1 \x01é", t) for i, t in enumerate(TRAPS + ["é\U0001F600" * 5, "long " * 9000])]
    rows += [(100 + n, None, t) for n, (_, t) in enumerate(ODD_TEXTS)] + [(None, "u", "null id"), (None, "u", "null id"), (500, "u", "null id"),
                                                                        (None, "u", "alone"), (None, "v", "alone"), (501, "r", "same"), (501, "r", "same")]
    path = str(tmp_path / "archive")
    warc.write(make(rows, "page_id long, url string, html string"), path, chunk=chunk)
    check_warc(rows, warc.read(spark, path).collect())
    text = b"".join(gzip.open(f).read() for f in glob.glob(f"{path}/*.gz"))
    at = n = 0  # the archive is well formed by its lengths alone
    while at < len(text):
        head = text[at:text.index(b"\r\n\r\n", at)]
        assert head.startswith(b"WARC/1.1\r\n")
        at += len(head) + 4 + int(re.search(rb"Content-Length: (\d+)", head)[1])
        assert text[at:at + 4] == b"\r\n\r\n"
        at, n = at + 4, n + 1
    chunks = warc.chunk_table(spark, path).collect()
    assert n == len(chunks)
    whole = collections.defaultdict(bytes)
    for c in sorted(chunks, key=lambda c: c.chunk):
        if c.record_type == "response" and c.page_id not in (None, "501"):
            whole[c.page_id] += bytes(c.data)
            assert c.payload_bytes == len(whole[c.page_id]) and len(bytes(c.data).decode()) <= chunk
            assert c.payload_digest == base64.b32encode(hashlib.sha1(whole[c.page_id]).digest()).decode()
    payload = {str(i): (h or "").encode() for i, _, h in rows}
    assert whole and all(whole[i] == payload[i] for i in whole)


def test_warc_empty_and_small(make, spark, tmp_path):
    warc.write(make([], "page_id long, url string, html string"), str(tmp_path / "a"))
    assert warc.read(spark, str(tmp_path / "a")).collect() == []
    warc.write(make([(1, "u", "ab"), (2, "u", "ab")], "page_id long, url string, html string"), str(tmp_path / "b"), min_bytes=3)
    assert {r.record_type for r in warc.read(spark, str(tmp_path / "b")).collect()} == {"response"}


# ------------------------------------------------------------------ URL rules

def judge(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host):])[0]
        host = "".join(c.lower() if c < "\x80" else c for c in host)
    best = None
    for verdict, h, p in sorted(rules):
        if host and (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or (len(h + p), h + p) >= (len(best[1]), best[1])):
            best = (verdict, h + p)
    return host, path, best and best[1], best[0] if best else default


def test_rules_whole_table(spark):
    got = {r.page_id: tuple(r)[1:] for r in queries.op8_url_rules(spark, SF).collect()}
    want = {i: judge(u, queries.RULES) for i, u, _ in pages()}
    assert got == want and len({w[2] for w in want.values()}) > 1
    sql = duckdb.sql(queries.ORACLE["op8_url_rules"].replace("FROM pages", f"FROM '{SF}/pages.parquet'")).fetchall()
    assert {r[0]: r[1:] for r in sql} == want


ODD_URLS = [None, "", "no scheme", "http://", "HTTP://Ex.ORG", "http://ex.org/", "http://a.ex.org/es/x?y#z", "http://ex.org/en/1", "http://notex.org/en/12",
            "http://ex.org?x/en/1", "http://É.ex.org/en/19", "x://ex.org/en/1://ex.org", "http://ex.org#/en/1", "http://ex.org/en\n/1", "http://" + "a." * 5000 + "org/" + "p" * 5000]


@pytest.mark.parametrize("max_bits", [1 << 30, 1])
def test_rules_odd_urls(make, max_bits):
    rules = [("allow", "org", "/"), ("block", "ex.org", "/es/"), ("block", "ex.org", "/en/1"), ("allow", "ex.org", "/en/1"), ("block", "a.ex.org", "/es/")]
    rows = list(enumerate(ODD_URLS)) + [(None, ODD_URLS[5]), (3, ODD_URLS[3])]
    table = make(rows, "page_id long, url string").withColumn("host", F.lit(1)).withColumn("keys", F.lit(2))
    got = collections.Counter(tuple(r) for r in urlfilter.judge(table, rules, max_bits=max_bits).collect())
    assert got == collections.Counter((i, *judge(u, rules)) for i, u in rows)
    assert urlfilter.judge(table.limit(0), rules).collect() == []
    assert {r.verdict for r in urlfilter.judge(table, []).collect()} == {"allow"}


def test_cascade_is_exact(spark):
    universe = spark.range(20_000).select(F.concat(F.lit("key/"), "id").alias("key"))
    listed = universe.where(F.xxhash64("key") % 7 == 0)
    levels = urlfilter.cascade(listed, universe)
    assert len(levels) > 2
    keys = urlfilter._hashed(universe, "key").toPandas()
    got = urlfilter.member(levels, keys.h1.to_numpy(), keys.h2.to_numpy())
    want = universe.select((F.xxhash64("key") % 7 == 0).alias("y")).toPandas().y.to_numpy()
    assert (got == want).all()


def test_rules_in_parts(spark):
    """Lists far over the bound: parts of several levels, passes one after the other, the same verdicts."""
    urls = spark.range(4_000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), F.col("id") % 900, F.lit(".org/p"), F.col("id") % 7).alias("url"))
    rules = [("block" if i % 3 else "allow", f"h{i}.org", "/p" if i % 2 else "/") for i in range(0, 900, 2)]
    host, path = urlfilter.host_and_path(F.col("url"))
    universe = urls.select(F.explode(urlfilter.url_keys(host, path, urlfilter.shapes(rules))).alias("key"))
    listed = spark.createDataFrame([(h + p,) for v, h, p in rules if v == "block"], "key string")
    got = urlfilter.parts(listed, universe, 1_000)
    assert len(got) > 1 and all(sum(x.bits for x in levels) <= 1_000 for _, _, levels in got) and max(len(levels) for _, _, levels in got) > 1
    rows = {r.page_id: tuple(r)[1:] for r in urlfilter.judge(urls, rules, max_bits=1_000).collect()}
    assert rows == {r.page_id: judge(r.url, rules) for r in urls.collect()}


# ------------------------------------------------------------------ tool calls

def test_tool_calls_whole_table(spark):
    turns = duckdb.sql(f"select conv_id, turn, role, text from '{SF}/conversations.parquet'").fetchall()
    got = {(r.conv_id, r.call_id): r for r in queries.op7_tool_calls(spark, SF).collect()}
    calls = {(c, t): (r, x) for c, t, r, x in turns if r in ("user", "system")}
    results = {(c, t - 1): x for c, t, r, x in turns if r == "assistant"}
    assert set(got) == {(c, f"call-{t}") for c, t in {*calls, *results}}
    for (c, t) in {*calls, *results}:
        r = got[(c, f"call-{t}")]
        out = json.loads(r.json)
        assert r.json == json.dumps(out, sort_keys=True, separators=(",", ":"), ensure_ascii=False) and r.level == 0
        assert out.get("result") == results.get((c, t))
        if (c, t) in calls:
            role, x = calls[(c, t)]
            ok = len(x) >= 20 if role == "user" else len(x) >= 1
            assert r.status == ("invalid" if not ok else "ok" if (c, t) in results else "no_result")
            if ok:
                assert out["arguments"] == {"chars": len(x), "prompt": x}
        else:
            assert r.status == "orphan"


def test_tool_calls_order_and_faults(make):
    calls = [("a", "1", 5, "t", '{"x": 1}', ["2"]), ("a", "2", 6, "t", '{"x": 2.5}', ["3", "gone"]), ("a", "3", 7, "t", '{"x":NaN}', None),
             ("b", "1", 1, "t", None, []), ("b", "2", 2, "u", "{}", ["1"]), ("b", "2", 2, "u", "{}", ["1"]), (None, None, 3, "t", "[1]", None),
             ("c", "1", 1, "t", '{"y":"é\\u0007","x":3}', ["2"]), ("c", "2", 2, "t", '{"x":"s"}', ["1"]), ("c", "3", 3, "t", "{", ["2", None])]
    results = [("a", "1", 8, "r1"), ("a", "1", 9, "r2"), ("z", "9", 1, "lone"), (None, None, 4, None)]
    got = toolcalls.link(make(calls, "conv_id string, call_id string, position long, tool string, arguments string, after array<string>"),
                         make(results, "conv_id string, call_id string, position long, content string"),
                         {"t": {"type": "object", "required": ["x"], "properties": {"x": {"type": "integer"}}}})
    got = {(r.conv_id, r.call_id): (r.level, r.status, r.fault, r.copies) for r in got.collect()}
    assert got == {
        ("a", "3"): (0, "invalid", "$: json", 1), ("a", "2"): (1, "invalid", "$.x: type", 1), ("a", "1"): (2, "ok", None, 1),
        ("b", "1"): (0, "invalid", "$: type", 1), ("b", "2"): (0, "invalid", "$: tool", 2), (None, None): (0, "invalid", "$: type", 1),
        ("c", "1"): (-1, "no_result", None, 1), ("c", "2"): (-1, "invalid", "$.x: type", 1), ("c", "3"): (-1, "invalid", "$: json", 1),
        ("z", "9"): (0, "orphan", None, 0)}


def test_tool_calls_empty(make):
    turns = make([], "conv_id long, turn long, role string, text string")
    assert toolcalls.link(*toolcalls.from_turns(turns), toolcalls.SCHEMAS).collect() == []
    odd = make([(1, 0, None, "x"), (None, 0, "user", None), (None, None, "assistant", "y"), (1, 1, "user", ""), (2, 0, "user", "long " * 20_000)],
               "conv_id long, turn long, role string, text string")
    assert sorted(r.status for r in toolcalls.link(*toolcalls.from_turns(odd), toolcalls.SCHEMAS).collect()) == ["invalid", "invalid", "no_result", "orphan"]


def test_schema_faults():
    s = {"type": "object", "properties": {"a": {"type": "array", "items": {"type": "number", "minimum": 0}, "maxItems": 2}, "b": {"enum": [1, "x"]},
                                          "c": {"type": ["string", "null"], "minLength": 2}}, "additionalProperties": False}
    cases = {'{"a":[1,2]}': None, '{"a":[1,-2]}': "$.a[1]: range", '{"a":[1,2,3]}': "$.a: items", '{"b":2}': "$.b: enum", '{"c":null}': None,
             '{"c":"x"}': "$.c: length", '{"d":1}': "$.d: unknown", '{"a":[true]}': "$.a[0]: type"}
    for text, want in cases.items():
        assert toolcalls.fault(json.loads(text), s) == want


# ------------------------------------------------------------------ SentencePiece transducer

MODEL = queries.vocabulary("piece_bpe_32k.model")


def odd_strings():
    rng = random.Random(4)
    alphabet = "aaabcdeeéßnst  \n\t.,'日本语\U0001F600́0123456789_-ΩЖب\u3000▁"
    yield from (t or "" for _, t in ODD_TEXTS)
    for n in list(range(30)) * 12:
        yield "".join(rng.choice(alphabet) for _ in range(n))
    for n in range(40):
        yield " " * n + "x" * n + "ab" * n


def test_transducer_matches_library():
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    t = spwfst.transducer(MODEL)
    for s in odd_strings():
        assert t.encode(s) == sp.encode(s), s[:50]
        assert t.decode(t.encode(s)) == s.replace("▁", " "), s[:50]
    for _, s, _ in duckdb.sql(f"select doc_id, text, lang from '{SF}/documents.parquet'").fetchall():
        assert t.encode(s) == sp.encode(s)


def test_unigram_shortest_path():
    pieces = [("<unk>", 0.0, 2)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    pieces += [(p, s, 1) for p, s in [("▁", -2.0), ("a", -2.0), ("b", -2.5), ("ab", -3.0), ("ba", -3.2), ("aba", -4.0), ("▁a", -2.7), ("bb", -6.0)]]
    t = spwfst.Transducer(pieces, spwfst.UNIGRAM)

    def brute(text):
        if not text:
            return 0.0, []
        options = [(-t.pieces[text[:n]][1], text[:n]) for n in range(1, t.longest + 1) if text[:n] in t.pieces] or [(10 - t.least, text[0])]
        return min(((w + brute(text[len(p):])[0], [p] + brute(text[len(p):])[1]) for w, p in options), key=lambda e: e[0])

    def weight(path):
        return sum(-t.pieces[p][1] if p in t.pieces else 10 - t.least for p in path)

    rng = random.Random(1)
    for _ in range(200):
        text = "▁" + "".join(rng.choice("abé▁") for _ in range(rng.randint(0, 8)))
        path = t.shortest(text)
        assert "".join(path) == text and abs(weight(path) - brute(text)[0]) < 1e-9
    assert t.decode(t.encode("abé b")) == "abé b"


def test_transducer_whole_table(spark):
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = {r.doc_id: r for r in queries.op10_sentencepiece(spark, SF).collect()}
    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    assert len(got) == len(rows)
    for i, s in rows:
        assert list(got[i].ids) == sp.encode(s or "") and got[i].n_tokens == len(got[i].ids) and got[i].round_trip


def test_transducer_odd_rows(make):
    docs = make(ODD_TEXTS, "doc_id long, text string")
    got = spwfst.encode_table(docs, MODEL)
    got = got.select("doc_id", "ids", spwfst.round_trip(F.col("ids"), F.col("text"), MODEL).alias("ok")).collect()
    assert len(got) == len(ODD_TEXTS) and all(r.ok for r in got)
    assert spwfst.encode_table(docs.limit(0), MODEL).collect() == []
    checked = spwfst.encode_checked(docs, MODEL)
    assert checked.columns == ["doc_id", "ids", "n_tokens", "round_trip"]
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.ids)
    rows = sorted(checked.collect(), key=key)
    assert [(r.doc_id, r.ids) for r in rows] == [(r.doc_id, r.ids) for r in sorted(got, key=key)]
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in rows)
    assert spwfst.encode_checked(docs.limit(0), MODEL).collect() == []


def test_transducer_blocks(make, monkeypatch):
    """Texts longer than a block, and blocks of several texts, in one batch."""
    docs = make([(i, t) for i, t in enumerate(["ab " * 300, "", None, "x", "longer " * 200, "y z"])], "doc_id long, text string")
    batch = pa.RecordBatch.from_pylist([{"doc_id": r.doc_id, "text": r.text} for r in docs.select("doc_id", "text").collect()])
    monkeypatch.setattr(spwfst, "BLOCK", 500)
    parts = list(spwfst._blocks(batch))
    assert len(parts) == 2 and pa.Table.from_batches(parts).to_pylist() == batch.to_pylist()
    assert list(spwfst._blocks(batch.slice(0, 0))) == []
