"""The queries of the training-data operators: opN_<name> and the pipeline."""

from __future__ import annotations

from corpus_pipeline import ORACLE_SQL
from corpus_pipeline import run as run_pipeline

from . import ann, bpe, fingerprints, licenses, lm, mixing, packing, ranked, simhash, substrings, toxicity, trie, urls
from .common import table


def op1_mixing(spark, sf_dir):
    return mixing.mix_plan(table(spark, sf_dir, "documents"))


def op2_neighbours(spark, sf_dir):
    return ann.search_hundredths(table(spark, sf_dir, "embeddings"))


def op3_substrings(spark, sf_dir):
    return substrings.repeats_report(table(spark, sf_dir, "documents"))


def op4_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_simhash_components(spark, sf_dir):
    return simhash.fingerprint_components(table(spark, sf_dir, "documents"))


def op6_licenses(spark, sf_dir):
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op7_pseudo_likelihood(spark, sf_dir):
    return lm.pseudo_likelihood(table(spark, sf_dir, "documents"))


def op8_urls(spark, sf_dir):
    return urls.judge(table(spark, sf_dir, "pages"))


def op9_fingerprints(spark, sf_dir):
    return fingerprints.document_fingerprints(table(spark, sf_dir, "documents"))


def op10_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark, sf_dir):
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_bpe(spark, sf_dir):
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op13_ranked_search(spark, sf_dir):
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict:
    found = {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}
    return found | {"pipeline": run_pipeline}


_OP3_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM w, unnest(range(1, len(ws) - 11)) t(i) WHERE len(ws) >= 13),
m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) < doc_id AS rep FROM g),
p AS (SELECT doc_id, i, ws[i] AS word FROM w, unnest(range(1, len(ws) + 1)) t(i)),
c AS (SELECT p.doc_id, p.i, word, coalesce(bool_or(rep) OVER (PARTITION BY p.doc_id ORDER BY p.i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW), false) AS gone FROM p LEFT JOIN m ON p.doc_id = m.doc_id AND p.i = m.i),
r AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT w.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN r USING (doc_id)
"""


#: The sums over subtrees as sums over members: each node counts at its smallest member's conversation.
#: DuckDB has no crc32: its table of 256 entries is worked out bit by bit, and read byte by byte.
_OP11_SQL = r"""
WITH bits AS (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a % 2 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END) AS v FROM range(256) t(i)),
tab AS (SELECT list(v ORDER BY i) AS v FROM bits),
convs AS (SELECT conv_id, count(*) AS own, conv_id - conv_id % 5 AS giver FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, own, giver, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
        lambda a, b: xor(a >> 8, v[xor(a & 255, b) + 1])), 4294967295::BIGINT) % 9 AS h FROM convs, tab),
r AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place, coalesce(role, '') AS role, coalesce(text, '') AS text
      FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT h.conv_id, h.giver, h.h, h.own, least(h.h, coalesce(g.own, 0)) AS taken FROM h LEFT JOIN h g ON h.giver = g.conv_id),
b AS (SELECT k.conv_id, place AS d, role, text FROM k JOIN r ON r.conv_id = k.giver AND place <= taken
      UNION ALL SELECT k.conv_id, place - h + taken, role, text FROM k JOIN r ON r.conv_id = k.conv_id AND place > h),
p AS (SELECT conv_id, d, strlen(text) AS bytes, string_agg(md5(md5(role) || md5(text)), '' ORDER BY d) OVER w AS seq FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY d)
      UNION ALL SELECT conv_id, 0, 0, '' FROM k),
l AS (SELECT conv_id, max(d) AS len FROM p GROUP BY conv_id),
n AS (SELECT d, seq, min(p.conv_id) AS node, count(*) AS n_convs, max(bytes) AS bytes, coalesce(string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id) FILTER (d = len), '') AS ids, count(*) FILTER (d = len) = count(*) AS leaf
      FROM p JOIN l USING (conv_id) GROUP BY d, seq),
m AS (SELECT p.conv_id, p.d, p.seq, n.node, sum(CASE WHEN n.node = p.conv_id THEN (n_convs - 1) * n.bytes ELSE 0 END) OVER f AS saved, max(CASE WHEN leaf AND n.node = p.conv_id THEN 1 ELSE 0 END) OVER f AS leaves
      FROM p JOIN n ON p.d = n.d AND p.seq = n.seq WINDOW f AS (PARTITION BY p.conv_id ORDER BY p.d DESC)),
s AS (SELECT d, seq, sum(saved)::BIGINT AS saved_tokens, sum(leaves)::BIGINT AS n_leaves FROM m GROUP BY d, seq),
c AS (SELECT d - 1 AS d, seq[:-33] AS seq, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL)
SELECT n.node AS conv_id, n.d AS depth, u.node AS parent_conv_id, n.n_convs, coalesce(n_children, 0)::BIGINT AS n_children, n_leaves, saved_tokens, sha256(n.ids) AS ends_sha256
FROM n JOIN s ON n.d = s.d AND n.seq = s.seq LEFT JOIN c ON n.d = c.d AND n.seq = c.seq LEFT JOIN n u ON n.d > 0 AND u.d = n.d - 1 AND u.seq = n.seq[:-33]
"""
_OP13_SQL = r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
d AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
c AS (SELECT count(*) AS docs, sum(n)::BIGINT AS len FROM d),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, c GROUP BY term, docs),
s AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // len))))::BIGINT AS score
      FROM q JOIN tf USING (term) JOIN w USING (term) JOIN d USING (doc_id), c GROUP BY item_id, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY rank <= 10
"""


def oracle_sql() -> dict:
    found = {"op3_substrings": _OP3_SQL, "op11_prefix_trie": _OP11_SQL, "op13_ranked_search": _OP13_SQL}
    return found | ({"pipeline": ORACLE_SQL} if ORACLE_SQL else {})
