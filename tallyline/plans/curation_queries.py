"""Queries of corpus curation: names that leak, calls and their results, rewrites that are none, lines shared with a benchmark."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyline.operators import curation

from . import ledger
from .registry import register


@register("leaked_names", """WITH x AS (SELECT p_partkey, 'Ask about (' || replace(initcap_, ' ', '  ') || CASE p_size % 4 WHEN 0 THEN ' League' WHEN 1 THEN ', Then' WHEN 2 THEN ' now' ELSE '' END || ') and ' || p_brand || '!' AS text FROM (SELECT *, list_aggregate([upper(w[1]) || w[2:] FOR w IN string_split(p_name, ' ')], 'string_agg', ' ') AS initcap_ FROM part)),
    n AS (SELECT DISTINCT list_aggregate([upper(w[1]) || w[2:] FOR w IN string_split(p_name, ' ')], 'string_agg', ' ') AS name FROM part WHERE p_partkey % 3 = 0 UNION SELECT DISTINCT p_brand FROM part WHERE p_size > 45)
    SELECT p_partkey, name AS leaked FROM x JOIN n ON regexp_matches(regexp_replace(text, '\\s+', ' ', 'g'), '(^|[^A-Za-z0-9])' || name || '([^A-Za-z0-9 ]|$| [^A-Z])')""".replace("\\\\", "\\"))
def leaked_names(spark, sf_dir):
    part = ledger.table(spark, sf_dir, "part")
    then = F.element_at(F.array(F.lit(" League"), F.lit(", Then"), F.lit(" now"), F.lit("")), (F.col("p_size") % 4 + 1).cast("int"))
    texts = part.select("p_partkey", F.concat(F.lit("Ask about ("), F.replace(F.initcap("p_name"), F.lit(" "), F.lit("  ")), then, F.lit(") and "), "p_brand", F.lit("!")).alias("text"))
    names = part.filter("p_partkey % 3 = 0").select(F.initcap("p_name").alias("name")).union(part.filter("p_size > 45").select("p_brand"))
    return curation.leaked_names(texts, names).select("p_partkey", "leaked")


_CALLS = """c AS (SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN 'talk' WHEN role = 'user' THEN 'call' ELSE 'result' END AS kind, CASE WHEN turn % 5 < 4 THEN 'k' || (CASE WHEN conv_id % 7 = 0 AND turn = 3 THEN 0 WHEN conv_id % 11 = 0 AND turn IN (1, 2) THEN 3 - turn ELSE turn // 2 END) END AS call_id FROM conversations)"""


@register("call_faults", f"""WITH {_CALLS}, l AS (SELECT *, lead(call_id) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM c), w AS (SELECT *, lag(kind) OVER o AS b, lead(kind) OVER o AS a FROM l WHERE kind <> 'talk' WINDOW o AS (PARTITION BY conv_id, call_id ORDER BY turn)),
    f AS (SELECT *, CASE WHEN kind = 'result' AND coalesce(b, '') <> 'call' THEN 'result without call' WHEN kind = 'call' AND b = 'call' THEN 'call twice' WHEN kind = 'call' AND a IS NULL THEN 'call without result' WHEN kind = 'call' AND coalesce(nxt, '') <> call_id THEN 'late' END AS fault FROM w),
    g AS (SELECT conv_id, count(*) FILTER (kind = 'call') AS calls, arg_min(fault, turn) FILTER (fault IS NOT NULL) AS fault FROM f GROUP BY 1)
    SELECT conv_id, coalesce(calls, 0) AS calls, fault, fault IS NULL AS ok FROM (SELECT DISTINCT conv_id FROM c) LEFT JOIN g USING (conv_id)""")
def call_faults(spark, sf_dir):
    talk, turn = F.col("turn") % 5 == 4, F.col("turn")
    number = F.when((F.col("conv_id") % 7 == 0) & (turn == 3), 0).when((F.col("conv_id") % 11 == 0) & turn.isin(1, 2), 3 - turn).otherwise(F.floor(turn / 2))
    kind = F.when(talk, "talk").when(F.col("role") == "user", "call").otherwise("result")
    turns = ledger.table(spark, sf_dir, "conversations").select("conv_id", "turn", kind.alias("kind"), F.when(~talk, F.concat(F.lit("k"), number.cast("string"))).alias("call_id"))
    return curation.call_faults(turns)


@register("trivial_rewrites", """WITH p AS (SELECT p_partkey, p_name || ' ' || p_size AS original, CASE p_partkey % 4 WHEN 0 THEN upper(p_name) || ', ' || p_size || '!' WHEN 1 THEN p_size || ' ' || p_name WHEN 2 THEN NULL ELSE p_name || p_size END AS rewrite FROM part)
    SELECT p_partkey, coalesce(trim(regexp_replace(lower(original), '[^a-z0-9]+', ' ', 'g')) = trim(regexp_replace(lower(rewrite), '[^a-z0-9]+', ' ', 'g')), true) AS undone,
      CASE WHEN coalesce(trim(regexp_replace(lower(original), '[^a-z0-9]+', ' ', 'g')) = trim(regexp_replace(lower(rewrite), '[^a-z0-9]+', ' ', 'g')), true) THEN original ELSE rewrite END AS rewrite FROM p""")
def trivial_rewrites(spark, sf_dir):
    name, size, k = F.col("p_name"), F.col("p_size").cast("string"), F.col("p_partkey") % 4
    other = F.when(k == 0, F.concat(F.upper(name), F.lit(", "), size, F.lit("!"))).when(k == 1, F.concat(size, F.lit(" "), name)).when(k == 3, F.concat(name, size))
    pairs = ledger.table(spark, sf_dir, "part").select("p_partkey", F.concat(name, F.lit(" "), size).alias("original"), other.alias("rewrite"))
    return curation.undo_trivial(pairs).select("p_partkey", "undone", "rewrite")


@register("benchmark_lines", r"""WITH b AS (SELECT DISTINCT trim(regexp_replace(regexp_replace(lower(l), '[.\-]', ' ', 'g'), '[^a-z ]|  +', '', 'g')) AS k FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM benchmark)),
    d AS (SELECT doc_id, trim(regexp_replace(regexp_replace(lower(l), '[.\-]', ' ', 'g'), '[^a-z ]|  +', '', 'g')) AS k FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents))
    SELECT doc_id, count(*) AS lines FROM d WHERE k <> '' AND k IN (SELECT k FROM b) GROUP BY 1""")
def benchmark_lines(spark, sf_dir):
    """Lines of documents that are lines of a benchmark item, but for case and signs."""
    line = lambda df, *keep: df.select(*keep, F.explode(F.split("text", "\n")).alias("line"))
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower("line"), r"[.\-]", " "), "[^a-z ]|  +", ""))
    docs, items = (line(ledger.table(spark, sf_dir, n), *keep).select(*keep, plain.alias("text")) for n, keep in (("documents", ["doc_id"]), ("benchmark", [])))
    return curation.overlapping(docs, items).groupBy("doc_id").agg(F.count("*").alias("lines"))
