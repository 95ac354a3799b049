"""Registered queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, centroids, knn, langid, merkle, ngramjoin, packing, pii, simhash, spwfst, toolcalls, urlfilter, warc
from .common import shared_path, table

QUERIES: dict = {}
ORACLE: dict = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file; the folder is QUILLSCAN_TOKENIZERS or the installed package's."""
    folder = os.environ.get("QUILLSCAN_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers
    return public_tokenizers.path(name)


@register("op1_pii")
def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


@register("op2_voronoi")
def op2_voronoi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10, 1024)


@register("op3_collisions")
def op3_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


@register("op4_warc")
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    return warc.read(spark, path)


@register("op5_language")
def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


@register("op6_packing")
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


CALLS_SQL = """
WITH calls AS (SELECT conv_id, 'call-' || turn AS call_id, min(turn) AS position, min(CASE role WHEN 'user' THEN 'respond' ELSE 'instruct' END) AS tool,
                      min(text) AS text, count(*) AS copies FROM conversations WHERE role IN ('user', 'system') GROUP BY ALL),
results AS (SELECT conv_id AS r_conv, 'call-' || (turn - 1) AS r_call, min(turn) AS r_position, min(text) AS content
            FROM conversations WHERE role = 'assistant' GROUP BY ALL),
both_ AS (SELECT *, CASE WHEN tool = 'respond' AND length(text) < 1 THEN '$.chars: range' WHEN tool = 'respond' AND length(text) < 20 THEN '$.prompt: length'
                        WHEN tool = 'instruct' AND length(text) < 1 THEN '$.prompt: length' END AS fault
          FROM calls FULL JOIN results ON conv_id = r_conv AND call_id = r_call)
SELECT coalesce(conv_id, r_conv) AS conv_id, coalesce(call_id, r_call) AS call_id, CAST(0 AS BIGINT) AS level, coalesce(position, r_position) AS position, tool,
       CASE WHEN copies IS NULL THEN 'orphan' WHEN fault IS NOT NULL THEN 'invalid' WHEN r_conv IS NULL THEN 'no_result' ELSE 'ok' END AS status, fault,
       CAST(coalesce(copies, 0) AS BIGINT) AS copies,
       '{' || CASE WHEN copies IS NULL THEN '' WHEN fault IS NULL THEN '"arguments":{"chars":' || length(text) || ',"prompt":' || to_json(text) || '},'
                   ELSE '"arguments":' || to_json('{"prompt":' || to_json(text) || ',"chars":' || length(text) || '}') || ',' END
           || '"conv_id":' || to_json(CAST(coalesce(conv_id, r_conv) AS VARCHAR)) || ',"id":' || to_json(coalesce(call_id, r_call))
           || CASE WHEN r_conv IS NULL THEN '' ELSE ',"result":' || to_json(content) END
           || CASE WHEN copies IS NULL THEN '' ELSE ',"tool":' || to_json(tool) || ',"valid":' || CASE WHEN fault IS NULL THEN 'true' ELSE 'false' END END
           || '}' AS json FROM both_"""


@register("op7_tool_calls", CALLS_SQL)
def op7_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toolcalls.link(*toolcalls.from_turns(table(spark, sf_dir, "conversations")), toolcalls.SCHEMAS)


#: (verdict, host, path prefix)
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/")]

_RULE_ROWS = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
URL_SQL = f"""
WITH rests AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{urlfilter.UPPER}', '{urlfilter.LOWER}') AS host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests),
rules(verdict, h, p) AS (VALUES {_RULE_ROWS}),
judged AS (SELECT page_id, host, path,
    (SELECT max(struct_pack(n := length(h || p), rule := h || p, verdict := verdict)) FROM rules
     WHERE host <> '' AND (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS best FROM parts)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM judged"""


@register("op8_url_rules", URL_SQL)
def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), RULES)


@register("op9_simhash")
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@register("op10_sentencepiece")
def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spwfst.encode_checked(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


#: A step of CRC-32 over the digits of the id, and the tree level by level.
MERKLE_SQL = """
WITH RECURSIVE crcs AS (
    SELECT *, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
                          lambda r, b: list_reduce([xor(r, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
                                                   lambda x, z: xor(x >> 1, (x & 1) * 3988292384::BIGINT))) AS inverse FROM documents),
parts AS (SELECT doc_id, lang, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
                 || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
                 text, CASE WHEN xor(inverse, 4294967295::BIGINT) % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
                            ELSE text END AS changed FROM crcs),
hashes AS (SELECT doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
                  sha256(head || coalesce(strlen(changed) || ':' || changed, '-')) AS tampered FROM parts),
leaves AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n FROM hashes),
up(lang, level, idx, digest, n) AS (
    SELECT lang, 0, idx, leaf, n FROM leaves
    UNION ALL
    SELECT lang, level + 1, idx // 8, sha256(string_agg(digest, '' ORDER BY idx)), (n + 7) // 8 FROM up WHERE n > 1 GROUP BY lang, level, idx // 8, n),
subroots AS (SELECT lang, digest AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS top, count(*) OVER () AS tops FROM up WHERE n = 1),
above(level, idx, digest, n) AS (
    SELECT 0, top, subroot, tops FROM subroots
    UNION ALL
    SELECT level + 1, idx // 8, sha256(string_agg(digest, '' ORDER BY idx)), (n + 7) // 8 FROM above WHERE n > 1 GROUP BY level, idx // 8, n),
climb(lang, leaf_idx, level, idx, n, folded, proof) AS (
    SELECT lang, idx, 0, idx, n, tampered, '' FROM leaves
    UNION ALL
    SELECT c.lang, c.leaf_idx, c.level + 1, c.idx // 8, (c.n + 7) // 8,
           sha256(string_agg(CASE WHEN u.idx = c.idx THEN c.folded ELSE u.digest END, '' ORDER BY u.idx)),
           c.proof || coalesce(string_agg(u.digest, '' ORDER BY u.idx) FILTER (u.idx <> c.idx), '')
    FROM climb c JOIN up u ON u.lang IS NOT DISTINCT FROM c.lang AND u.level = c.level AND u.idx // 8 = c.idx // 8
    WHERE c.n > 1 GROUP BY c.lang, c.leaf_idx, c.level, c.idx, c.n, c.folded, c.proof),
last(lang, leaf_idx, level, idx, n, folded, proof) AS (
    SELECT c.lang, c.leaf_idx, 0, s.top, s.tops, c.folded, c.proof FROM climb c JOIN subroots s ON s.lang IS NOT DISTINCT FROM c.lang WHERE c.n = 1
    UNION ALL
    SELECT c.lang, c.leaf_idx, c.level + 1, c.idx // 8, (c.n + 7) // 8,
           sha256(string_agg(CASE WHEN u.idx = c.idx THEN c.folded ELSE u.digest END, '' ORDER BY u.idx)),
           c.proof || coalesce(string_agg(u.digest, '' ORDER BY u.idx) FILTER (u.idx <> c.idx), '')
    FROM last c JOIN above u ON u.level = c.level AND u.idx // 8 = c.idx // 8
    WHERE c.n > 1 GROUP BY c.lang, c.leaf_idx, c.level, c.idx, c.n, c.folded, c.proof)
SELECT l.doc_id, l.leaf, s.subroot, a.digest AS root, sha256(e.proof) AS proof_sha256, e.folded AS folded_root, e.folded = a.digest AS verified
FROM leaves l JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang JOIN above a ON a.n = 1
     JOIN last e ON e.lang IS NOT DISTINCT FROM l.lang AND e.leaf_idx = l.idx AND e.n = 1"""


@register("op11_merkle", MERKLE_SQL)
def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(table(spark, sf_dir, "documents"))


def _centroid_sql(k: int = 40, rounds: int = 5) -> str:
    """Rounds of assignment and means, written out one after the other."""
    parts = ["""kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
             FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
             "flat AS MATERIALIZED (SELECT r, unnest(range(64)) AS i, unnest(v) AS x FROM kept)",
             f"""c0 AS MATERIALIZED (SELECT c, unnest(range(64)) AS i, unnest(v) AS x FROM (SELECT v, row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS c
             FROM kept ORDER BY c LIMIT {k}))"""]
    for n in range(rounds + 1):
        parts.append(f"""a{n} AS MATERIALIZED (SELECT r, min(struct_pack(d := d, c := c)) AS best FROM (SELECT r, c, sum((f.x - m.x) * (f.x - m.x))::BIGINT AS d
             FROM flat f JOIN c{n} m USING (i) GROUP BY r, c) GROUP BY r)""")
        if n < rounds:
            parts.append(f"""c{n + 1} AS MATERIALIZED (SELECT m.c, m.i, CASE WHEN t.n IS NULL THEN m.x ELSE CAST((t.s - ((t.s % t.n) + t.n) % t.n) // t.n AS BIGINT) END AS x FROM c{n} m
             LEFT JOIN (SELECT best.c AS c, i, sum(x)::BIGINT AS s, count(*) AS n FROM flat JOIN a{n} USING (r) GROUP BY ALL) t ON t.c = m.c AND t.i = m.i)""")
    return "WITH " + ",\n".join(parts) + f"""
    SELECT vec_id, CAST(best.c AS INTEGER) AS cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia,
           CAST(sum(best.d) OVER () AS BIGINT) AS inertia, digest AS centroid_sha256
    FROM kept JOIN a{rounds} USING (r) JOIN (SELECT c AS number, sha256(string_agg(x, ',' ORDER BY i)) AS digest FROM c{rounds} GROUP BY c) ON number = best.c"""


@register("op12_centroids", _centroid_sql())
def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


@register("op13_ngram_join")
def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.groups(table(spark, sf_dir, "documents"))
