"""One registered query per corpus operator, over whole tables, and SQL for those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm import (hard_negatives, line_dedup, minhash, mixing, multi_index, packing, prefix_trie, repeats, sharding, simhash, topk,
                            toxicity, warc)
from chronoloom.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SHARDS = 8


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_file(), capacity=1024, eos=2)


@query
def op2_hypergeometric_sharding(spark, sf_dir):
    text = F.col("text")
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"))
    placed = sharding.shuffle_shards(rows, by=["doc_id", "size", "text_crc32"], shards=SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op3_entropy_mixing(spark, sf_dir):
    mixed = mixing.mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), most=3.0)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@query
def op4_minhash_coordinates(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


@query
def op5_line_dedup(spark, sf_dir):
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@query
def op6_warc_derivatives(spark, sf_dir):
    return warc.derive(warc.responses(table(spark, sf_dir, "pages")))


@query
def op7_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op8_multi_index(spark, sf_dir):
    return multi_index.nearest(table(spark, sf_dir, "embeddings"), k=20, every=20)


@query
def op9_fixed_block_repeats(spark, sf_dir):
    return repeats.drop_repeats(table(spark, sf_dir, "documents"), window=35).drop("spans")


@query
def op10_branch_and_bound(spark, sf_dir):
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"), k=5, every=50, scale=256.0)


@query
def op11_simhash_golay(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, bits=2).select("doc_id", "fingerprint", "component_id")


@query
def op12_hard_negatives(spark, sf_dir):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), label, every=50, positives=5, negatives=3, low=50, high=95)


@query
def op13_prefix_trie(spark, sf_dir):
    conv = F.col("conv_id")
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"), borrowed=F.crc32(conv.cast("string").cast("binary")) % 4, lender=conv - conv % 20)


_WORDS = r"coalesce(regexp_extract_all({}, '[^\x20\x09-\x0D]+'), [])"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _sql_text() -> str:
    out = "payload"
    for pattern, to in warc.TO_TEXT:
        put = to.replace("'", "''").replace("\n", "' || chr(10) || '")
        out = f"regexp_replace({out}, '{pattern.replace(chr(39), chr(39) * 2)}', '{put}', 'g')"
    return out


_CRLF = "chr(13) || chr(10)"
_UUID = "'<urn:uuid:' || substr({0}, 1, 8) || '-' || substr({0}, 9, 4) || '-' || substr({0}, 13, 4) || '-' || substr({0}, 17, 4) || '-' || substr({0}, 21, 12) || '>'"

ORACLES: dict[str, str] = {
    "op4_minhash_coordinates": f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 3], ' ') END AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id
      JOIN n p ON p.doc_id = x.doc_id JOIN n q ON q.doc_id = y.doc_id
      GROUP BY x.doc_id, y.doc_id, p.n, q.n HAVING 100 * count(*) >= 80 * (p.n + q.n - count(*))),
r(node, reach) AS (SELECT a, b FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.reach = e.a),
c AS (SELECT node, min(least(node, reach)) AS component FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component, d.doc_id) AS component_id, coalesce(c.component, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.node = d.doc_id""",
    "op5_line_dedup": f"""
WITH l AS (SELECT doc_id, i - 1 AS line, ls[i] AS raw, {_WORDS.format("ls[i]")} AS w
           FROM (SELECT doc_id, string_split(text, chr(10)) AS ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
k AS (SELECT array_to_string(w, ' ') AS t, any_value(w) AS w, min(doc_id * 1000000 + line) AS first FROM l WHERE len(w) > 0 GROUP BY 1),
v AS (SELECT t, first, g, len(w) AS n, array_to_string(list_concat(w[1:g - 1], w[g + 1:]), ' ') AS v
      FROM (SELECT t, w, first, unnest(range(1, len(w) + 1)) AS g FROM k WHERE len(w) >= 8)),
near AS (SELECT x.t FROM v x JOIN v y ON x.v = y.v AND x.g = y.g AND y.first < x.first
         UNION SELECT x.t FROM v x JOIN k y ON x.v = y.t AND y.first < x.first AND len(y.w) >= 8
         UNION SELECT y.t FROM v x JOIN k y ON x.v = y.t AND x.first < y.first AND len(y.w) >= 8),
j AS (SELECT l.doc_id, l.line, l.raw, len(l.w) > 0 AND (near.t IS NOT NULL OR l.doc_id * 1000000 + l.line > k.first) AS gone
      FROM l LEFT JOIN k ON k.t = array_to_string(l.w, ' ') LEFT JOIN near ON near.t = k.t)
SELECT d.doc_id, coalesce(count(j.line), 0) AS n_lines, coalesce(count(*) FILTER (j.gone), 0) AS n_removed,
       CASE WHEN any_value(d.text) IS NOT NULL THEN sha256(coalesce(string_agg(j.raw, chr(10) ORDER BY j.line) FILTER (NOT j.gone), '')) END AS kept_sha256
FROM documents d LEFT JOIN j ON j.doc_id = d.doc_id GROUP BY d.doc_id""",
    "op6_warc_derivatives": f"""
WITH r AS (SELECT page_id, url, coalesce(html, '') AS payload, 'sha256:' || sha256(coalesce(html, '')) AS payload_digest FROM pages),
s AS (SELECT *, md5('response|' || coalesce(page_id::VARCHAR, '') || '|' || coalesce(url, '') || '|' || payload_digest) AS h,
      'HTTP/1.1 200 OK' || {_CRLF} || 'Content-Type: text/html; charset=utf-8' || {_CRLF} || 'Content-Length: ' || strlen(payload) || {_CRLF} AS http,
      regexp_replace(trim(regexp_extract(payload, '{warc.TITLE}', 1)), '[\\r\\n]+', ' ', 'g') AS title FROM r),
b AS (SELECT *, {_UUID.format("h")} AS refers_to,
      http || CASE WHEN title <> '' THEN 'title: ' || title || {_CRLF} ELSE '' END ||
      coalesce(array_to_string(list_transform(regexp_extract_all(payload, '{warc.LINK}', 1), lambda u: 'outlink: ' || u || {_CRLF}), ''), '') AS meta,
      {_sql_text()} AS txt FROM s),
k AS (SELECT *, 'metadata' AS record_type, 'application/warc-fields' AS media, meta AS block FROM b
      UNION ALL SELECT *, 'conversion', 'text/plain', txt FROM b),
o AS (SELECT *, md5(record_type || '|' || refers_to) AS g, 'sha256:' || sha256(block) AS block_digest FROM k),
p AS (SELECT *, {_UUID.format("g")} AS record_id FROM o)
SELECT page_id, record_type, record_id, refers_to, url AS target_uri, payload_digest, block_digest, strlen(block) AS content_length,
       concat_ws({_CRLF}, '{warc.VERSION}', 'WARC-Type: ' || record_type, 'WARC-Record-ID: ' || record_id, 'WARC-Refers-To: ' || refers_to,
                 'WARC-Target-URI: ' || url, 'WARC-Date: 2026-01-01T00:00:00Z', 'WARC-Payload-Digest: ' || payload_digest,
                 'WARC-Block-Digest: ' || block_digest, 'Content-Type: ' || media, 'Content-Length: ' || strlen(block)) AS headers, block
FROM p""",
    "op9_fixed_block_repeats": f"""
WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
x AS (SELECT doc_id, i, w[i] AS word, CASE WHEN i + 34 <= len(w) THEN array_to_string(w[i:i + 34], ' ') END AS win
      FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
r AS (SELECT win FROM x WHERE win IS NOT NULL GROUP BY win HAVING count(*) > 1),
f AS (SELECT x.*, max(CASE WHEN r.win IS NOT NULL THEN i END) OVER (PARTITION BY doc_id ORDER BY i) AS last FROM x LEFT JOIN r ON r.win = x.win),
g AS (SELECT *, last IS NOT NULL AND last >= i - 34 AS gone FROM f)
SELECT d.doc_id, any_value(len(d.w)) AS n_words, count(*) FILTER (g.gone) AS n_removed,
       sha256(coalesce(string_agg(g.word, ' ' ORDER BY g.i) FILTER (NOT g.gone), '')) AS kept_sha256
FROM d LEFT JOIN g ON g.doc_id = d.doc_id GROUP BY d.doc_id""",
    "op10_branch_and_bound": """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM e q JOIN e c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5""",
    "op12_hard_negatives": """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS anchor_id, c.vec_id, q.label = c.label AS same, list_inner_product(q.v, c.v)::BIGINT AS score
      FROM e q JOIN e c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INTEGER AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 3""",
    "op13_prefix_trie": f"""
WITH tbl AS (SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY n) AS t
             FROM (SELECT unnest(range(256)) AS n)),
t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
      FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY i) AS ts FROM t GROUP BY conv_id),
h AS (SELECT conv_id, ts, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda b: ascii(b)::BIGINT)),
                                          lambda x, b: xor(tbl.t[(xor(x, b) & 255) + 1], x >> 8)), 4294967295) % 4 AS h FROM c, tbl),
r AS (SELECT h.conv_id, list_concat(coalesce(b.ts[1:h.h], []), h.ts[h.h + 1:]) AS w FROM h LEFT JOIN c b ON b.conv_id = h.conv_id - h.conv_id % 20),
y AS (SELECT conv_id, d, w[1:d] AS k, len(w) = d AS last FROM (SELECT conv_id, w, unnest(range(0, len(w) + 1)) AS d FROM r)),
n AS (SELECT d, k, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '')) AS ends,
             CASE WHEN d = 0 THEN 0 ELSE len({_WORDS.format("k[d].text")}) END AS words FROM y GROUP BY d, k),
m AS (SELECT n.*, p.conv_id AS parent_conv_id, coalesce(q.kids, 0) AS kids, (n.n_convs - 1) * n.words AS saved
      FROM n LEFT JOIN n p ON p.d = n.d - 1 AND p.k = n.k[1:n.d - 1]
             LEFT JOIN (SELECT d - 1 AS d, k[1:d - 1] AS k, count(*) AS kids FROM n WHERE d > 0 GROUP BY ALL) q ON q.d = n.d AND q.k = n.k),
s AS (SELECT a AS d, k[1:a] AS k, count(*) FILTER (kids = 0) AS leaves, sum(saved) AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM m) GROUP BY ALL)
SELECT m.conv_id, m.d AS depth, m.parent_conv_id, m.n_convs, m.kids AS n_children, s.leaves AS n_leaves, s.saved::BIGINT AS saved_tokens, m.ends AS ends_sha256
FROM m JOIN s ON s.d = m.d AND s.k = m.k""",
}
