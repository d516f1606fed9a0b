"""Queries of the llm operators and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridloom.llm import groups, mixture, similar, spans, together, tokens
from gridloom.sources.tables import table

VOCABULARY = "byte_bpe_50k.tiktoken"


def p2_found(spark, d):
    """The records that are linked to another one, with their group."""
    return groups.link_groups(table(spark, d, "pair_matches"))


def p2_groups(spark, d):
    """Every record with its group."""
    return groups.all_groups(table(spark, d, "vertices"), table(spark, d, "pair_matches"))


def p4_found(spark, d):
    """Pairs of cells in at least 12 common nets, at least 6 times as many as by chance."""
    out = together.pairs_together(table(spark, d, "pins"), min_count=12, min_lift=(6, 1))
    return out.selectExpr("item_a as cell_a", "item_b as cell_b")


def p4_blocked(spark, d):
    """``p4_found`` with nets cut into chunks of about eight cells, so that most pairs come from pairs of chunks."""
    out = together.pairs_together(table(spark, d, "pins"), min_count=12, min_lift=(6, 1), chunk_items=8)
    return out.selectExpr("item_a as cell_a", "item_b as cell_b")


def p4_pairs(spark, d):
    """Every pair of a cell divisible by 50 and another one that share a net."""
    out = together.pairs_together(table(spark, d, "pins"), every=50)
    return out.selectExpr("item_a as cell_a", "item_b as cell_b", "n_ab", "n_a", "n_b", "round(lift, 6) as lift")


def p4_all_pairs(spark, d):
    """Every pair of cells that share a net."""
    out = together.pairs_together(table(spark, d, "pins"))
    return out.selectExpr("item_a as cell_a", "item_b as cell_b", "n_ab", "n_a", "n_b", "round(lift, 6) as lift")


def p5_found(spark, d):
    """Pairs of rows whose sets of columns have a Jaccard similarity of at least 0.75."""
    return similar.similar_pairs(table(spark, d, "csr_rows"), 3, 4).select("row_a", "row_b")


def p5_links(spark, d):
    """Every row that has columns, with its class of equal sets and its number of similar rows."""
    return similar.similar_summary(table(spark, d, "csr_rows"), 3, 4)


def p6_ids(spark, d):
    """Every document as token ids."""
    return tokens.encode_corpus(table(spark, d, "documents"), tokens.tokenizer_path(VOCABULARY))


def p6_decoded(spark, d):
    """Every document as text again, from its token ids."""
    path = tokens.tokenizer_path(VOCABULARY)
    return tokens.decode_corpus(p6_ids(spark, d), tokens.piece_table(spark, path))


def p7_mixture(spark, d):
    """The uses of every text in the mixture."""
    return mixture.mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets"), tokens.tokenizer_path(VOCABULARY))[0]


def p7_shares(spark, d):
    """The shares that the mixture reaches."""
    return mixture.mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets"), tokens.tokenizer_path(VOCABULARY))[1]


def p7_valid(spark, d):
    """What must hold of the mixture, source by source, recomputed from its rows: caps, single use of a text, the aim within one text, the share reported."""
    docs, targets = table(spark, d, "documents"), table(spark, d, "mix_targets")
    mix, shares = mixture.mix_sources(docs, targets, tokens.tokenizer_path(VOCABULARY))
    held = docs.where("text is not null").select("doc_id", F.md5("text").alias("digest"))
    used = mix.join(held, "doc_id").groupBy("source").agg(
        F.count("*").alias("rows"), F.countDistinct("digest").alias("texts"), F.sum(F.col("n_tokens") * F.col("copies")).alias("own"), F.max("copies").alias("most"), F.max("n_tokens").alias("longest")
    )
    everything = Window.partitionBy()  # one row a target
    full = shares.join(used, "source", "left").fillna(0, ["rows", "texts", "own", "most", "longest"])
    full = full.withColumn("total", F.sum("own").over(everything)).withColumn("longest", F.max("longest").over(everything))
    return full.select(
        "source", "n_texts", F.round("aim", 9).alias("aim"), (F.col("most") <= F.col("max_repeats")).alias("capped"), (F.col("rows") == F.col("texts")).alias("once"),
        (F.abs(F.col("own") - F.col("aim") * F.col("total")) <= 2 * F.col("longest")).alias("near"), (F.abs(F.col("actual_share") - F.col("own") / F.col("total")) < 1e-9).alias("reported"),
    )


def p8_found(spark, d):
    """The stretches of at least 200 code points that stand in another text too."""
    return spans.shared_spans(table(spark, d, "documents"), 200)


def p8_share(spark, d):
    """How much of every text stands in another text too."""
    docs = table(spark, d, "documents")
    return spans.shared_share(docs, spans.shared_spans(docs, 200))


QUERIES = {f.__name__: f for f in (p2_found, p2_groups, p4_found, p4_blocked, p4_pairs, p4_all_pairs, p5_found, p5_links, p6_ids, p6_decoded, p7_mixture, p7_shares, p7_valid, p8_found, p8_share)}

_GROUPS = """
WITH RECURSIVE half AS (SELECT DISTINCT least(i, j) AS a, greatest(i, j) AS b FROM pair_matches WHERE i IS NOT NULL AND j IS NOT NULL AND i <> j),
e AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
g(id, group_id) USING KEY (id) AS (
  SELECT a, least(a, min(b)) FROM e GROUP BY a
  UNION
  SELECT e.b, min(g.group_id) FROM g JOIN e ON e.a = g.id JOIN recurring.g h ON h.id = e.b WHERE g.group_id < h.group_id GROUP BY e.b)
"""
_PAIRS = """
WITH p AS (SELECT DISTINCT net, cell FROM pins WHERE net IS NOT NULL AND cell IS NOT NULL),
n AS (SELECT cell, count(*) AS n FROM p GROUP BY 1),
t AS (SELECT count(DISTINCT net) AS total FROM p),
c AS (SELECT a.cell AS cell_a, b.cell AS cell_b, count(*) AS n_ab FROM p a JOIN p b ON a.net = b.net AND a.cell < b.cell GROUP BY 1, 2),
s AS (SELECT c.*, x.n AS n_a, y.n AS n_b, total FROM c JOIN n x ON x.cell = cell_a JOIN n y ON y.cell = cell_b, t)
"""
_SETS = """
WITH v AS (SELECT DISTINCT i, unnest(cols) AS c FROM csr_rows WHERE i IS NOT NULL), s AS (SELECT DISTINCT i, c FROM v WHERE c IS NOT NULL),
k AS (SELECT i, count(*) AS k FROM s GROUP BY 1),
o AS (SELECT a.i AS row_a, b.i AS row_b, count(*) AS o FROM s a JOIN s b ON a.c = b.c AND a.i < b.i GROUP BY 1, 2),
p AS (SELECT row_a, row_b FROM o JOIN k x ON x.i = row_a JOIN k y ON y.i = row_b WHERE o * 4 >= (x.k + y.k - o) * 3)
"""

_SPANS = """
WITH t AS (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND length(text) >= 200),
w AS (SELECT doc_id, p, hash(substring(text, p + 1, 200)) AS h FROM (SELECT doc_id, text, unnest(range(length(text) - 199)) AS p FROM t)),
g AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) <> max(doc_id)),
s AS (SELECT doc_id, p FROM w SEMI JOIN g USING (h)),
n AS (SELECT *, CASE WHEN p - lag(p) OVER o <= 200 THEN 0 ELSE 1 END AS new FROM s WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM n),
f AS (SELECT doc_id, min(p) AS span_start, max(p) + 200 AS span_end FROM r GROUP BY doc_id, run)
"""

_P4 = _PAIRS + "SELECT cell_a, cell_b FROM s WHERE n_ab >= 12 AND n_ab * total >= 6 * n_a * n_b"
SQL = {
    "p7_valid": """
WITH d AS (SELECT arg_min(source, doc_id) AS source FROM documents SEMI JOIN mix_targets USING (source) WHERE text <> '' AND doc_id IS NOT NULL GROUP BY text),
n AS (SELECT source, count(*) AS n_texts FROM d GROUP BY 1),
t AS (SELECT source, target_share, coalesce(n_texts, 0) AS n_texts FROM mix_targets LEFT JOIN n USING (source))
SELECT source, n_texts, round(CASE WHEN n_texts > 0 THEN target_share / (SELECT sum(target_share) FROM t WHERE n_texts > 0) ELSE 0.0 END, 9) AS aim, true AS capped, true AS once, true AS near, true AS reported FROM t""",
    "p8_found": _SPANS + "SELECT doc_id, span_start, span_end FROM f",
    "p8_share": _SPANS + """, d AS (SELECT doc_id, max(coalesce(length(text), 0))::BIGINT AS n_chars FROM documents WHERE doc_id IS NOT NULL GROUP BY 1),
c AS (SELECT doc_id, count(*) AS n_spans, sum(span_end - span_start)::BIGINT AS shared_chars FROM f GROUP BY 1)
SELECT doc_id, n_chars, coalesce(n_spans, 0) AS n_spans, coalesce(shared_chars, 0) AS shared_chars, CASE WHEN n_chars > 0 THEN coalesce(shared_chars, 0) / n_chars ELSE 0.0 END AS shared_share
FROM d LEFT JOIN c USING (doc_id)""",
    "p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p2_found": _GROUPS + "SELECT id, group_id FROM g",
    "p2_groups": _GROUPS + """, r AS (SELECT id FROM vertices UNION SELECT i FROM pair_matches UNION SELECT j FROM pair_matches)
SELECT r.id, coalesce(g.group_id, r.id) AS group_id FROM r LEFT JOIN g ON g.id = r.id WHERE r.id IS NOT NULL""",
    "p4_found": _P4,
    "p4_blocked": _P4,
    "p4_pairs": _PAIRS + "SELECT cell_a, cell_b, n_ab, n_a, n_b, round(n_ab::DOUBLE * total / (n_a::DOUBLE * n_b), 6) AS lift FROM s WHERE cell_a % 50 = 0 OR cell_b % 50 = 0",
    "p4_all_pairs": _PAIRS + "SELECT cell_a, cell_b, n_ab, n_a, n_b, round(n_ab::DOUBLE * total / (n_a::DOUBLE * n_b), 6) AS lift FROM s",
    "p5_found": _SETS + "SELECT row_a, row_b FROM p",
    "p5_links": _SETS + """, w AS (SELECT i, list(c ORDER BY c) AS cols FROM s GROUP BY 1),
d AS (SELECT cols, min(i) AS class_id FROM w GROUP BY 1), l AS (SELECT row_a AS i FROM p UNION ALL SELECT row_b FROM p),
m AS (SELECT i, count(*) AS n FROM l GROUP BY 1)
SELECT w.i AS rec, class_id, coalesce(n, 0) AS n_links FROM w JOIN d USING (cols) LEFT JOIN m ON m.i = w.i""",
}
