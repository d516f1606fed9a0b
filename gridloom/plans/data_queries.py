"""Queries of the core operators on delivered lines and on skewed keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import bad_rows, heavy_keys
from gridloom.sources.tables import table


def _parsed(spark, d):
    return bad_rows.parse_entries(table(spark, d, "mtx_lines"), table(spark, d, "mtx_files"))


def p1_found(spark, d):
    """Lines that fail to parse."""
    return bad_rows.split_entries(_parsed(spark, d))[1].select("raw_id")


def p1_reasons(spark, d):
    """Each rejected line with its reason."""
    return bad_rows.split_entries(_parsed(spark, d))[1]


def p1_loaded(spark, d):
    """Each valid line as an entry of its matrix."""
    return bad_rows.split_entries(_parsed(spark, d))[0]


def p3_found(spark, d):
    """Rows and columns that hold at least 2 % of all entries."""
    return heavy_keys.heavy_keys(table(spark, d, "nonzeros")).select("axis", "file_id", "idx")


def p3_sums(spark, d):
    """Entries and sum of values of every row and every column."""
    return heavy_keys.key_sums(table(spark, d, "nonzeros")).withColumn("sum_v", F.round("sum_v", 4))


QUERIES = {f.__name__: f for f in (p1_found, p1_reasons, p1_loaded, p3_found, p3_sums)}

_CELL = '("([^"]|"")*"|[^"{d}]*)'


def _p1_cte() -> str:
    """Lines with their file's facts, then the cells of those that split well, as text."""
    cell = lambda d: '("(?:[^"]|"")*"|[^"' + d + ']*)'
    pats = [(d, r) for d, r in ((",", ","), (";", ";"), ("\t", r"\t"), ("|", r"\|"))]

    def split(n: int) -> str:
        names = "['a','b','c','d']" if n == 4 else "['a','b','c']"
        arms = " ".join(f"WHEN delim = {'chr(9)' if d == chr(9) else repr(d)} THEN regexp_extract(line, '(?s)\\A{r.join([cell(r)] * n)}\\z', {names})" for d, r in pats)
        whole = " ".join(f"WHEN delim = {'chr(9)' if d == chr(9) else repr(d)} THEN regexp_matches(line, '(?s)\\A{r.join([cell(r)] * n)}\\z')" for d, r in pats)
        return f"CASE WHEN NOT (CASE {whole} END) THEN NULL ELSE (CASE {arms} END) END"

    def many() -> str:
        """Whether a line is made of well quoted cells, however many."""
        return "CASE " + " ".join(f"WHEN delim = {'chr(9)' if d == chr(9) else repr(d)} THEN regexp_matches(line, '(?s)\\A{cell(r)}({r}{cell(r)})*\\z')" for d, r in pats) + " END"

    bare = lambda c: f"trim(CASE WHEN {c} LIKE '\"%' THEN replace({c}[2:-2], '\"\"', '\"') ELSE {c} END, ' ')"
    return f"""
WITH l AS (
  SELECT m.raw_id, m.file_id, m.line_no, m.line, f.file_id IS NOT NULL AS known, f.field, f.delim, f.n_rows, f.n_cols,
         coalesce(f.field IN ('real', 'double', 'integer', 'pattern'), false) AS sound
  FROM mtx_lines m LEFT JOIN mtx_files f USING (file_id) WHERE line IS NULL OR NOT starts_with(line, '%')),
s AS (SELECT *, CASE WHEN NOT sound THEN NULL ELSE ({many()}) END AS quoted, CASE WHEN sound AND field <> 'pattern' THEN {split(4)} END AS q, CASE WHEN sound AND field = 'pattern' THEN {split(3)} END AS t FROM l),
c AS (
  SELECT raw_id, file_id, line_no, line IS NULL AS missing, known, sound, quoted, delim, field, n_rows, n_cols, coalesce(q.a, t.a) AS r0, coalesce(q.b, t.b) AS c0, q.c AS v0, coalesce(q.d, t.c) AS n0 FROM s),
u AS (
  SELECT *, {bare("r0")} AS r, {bare("c0")} AS cc, {bare("v0")} AS v,
         CASE WHEN n0 LIKE '"%' THEN replace(n0[2:-2], '""', '"') ELSE n0 END AS note FROM c),
k AS (
  SELECT *, known AND sound AND r0 IS NOT NULL
    AND regexp_full_match(r, '[0-9]+') AND coalesce(try_cast(r AS HUGEINT) BETWEEN 1 AND n_rows, false)
    AND regexp_full_match(cc, '[0-9]+') AND coalesce(try_cast(cc AS HUGEINT) BETWEEN 1 AND n_cols, false)
    AND CASE WHEN field = 'pattern' THEN true
             WHEN field = 'integer' THEN regexp_full_match(v, '[+-]?[0-9]+') AND try_cast(ltrim(v, '+') AS BIGINT) IS NOT NULL
             ELSE regexp_full_match(v, '[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?')
                  AND coalesce(isfinite(try_cast(ltrim(v, '+') AS DOUBLE)), false) END AS good
  FROM u)"""


_AXES = """
WITH k AS (SELECT 'row' AS axis, file_id, i AS idx, v FROM nonzeros WHERE i IS NOT NULL
           UNION ALL SELECT 'col', file_id, j, v FROM nonzeros WHERE j IS NOT NULL),
s AS (SELECT axis, file_id, idx, count(*) AS n, count(v) AS n_v, round(sum(v), 4) AS sum_v FROM k GROUP BY ALL)"""

SQL = {
    "p1_found": _p1_cte() + " SELECT raw_id FROM k WHERE NOT coalesce(good, false)",
    "p1_loaded": _p1_cte() + """
SELECT raw_id, file_id, line_no, CAST(r AS BIGINT) AS row, CAST(cc AS BIGINT) AS col,
       CASE WHEN field <> 'pattern' THEN CAST(ltrim(v, '+') AS DOUBLE) END AS val,
       CASE WHEN field = 'integer' THEN CAST(ltrim(v, '+') AS BIGINT) END AS val_int, note
FROM k WHERE good""",
    "p1_reasons": _p1_cte() + """
SELECT raw_id, file_id, line_no,
  CASE WHEN missing THEN 'null line' WHEN NOT known THEN 'unknown file' WHEN NOT sound THEN 'unsupported field'
       WHEN coalesce(delim, '') = '' THEN 'no delimiter' WHEN NOT quoted THEN 'broken quoting' WHEN r0 IS NULL THEN 'wrong number of cells'
       WHEN NOT regexp_full_match(r, '[0-9]+') THEN 'row is not a number' WHEN NOT coalesce(try_cast(r AS HUGEINT) BETWEEN 1 AND n_rows, false) THEN 'row out of range'
       WHEN NOT regexp_full_match(cc, '[0-9]+') THEN 'column is not a number' WHEN NOT coalesce(try_cast(cc AS HUGEINT) BETWEEN 1 AND n_cols, false) THEN 'column out of range'
       WHEN NOT regexp_full_match(v, CASE WHEN field = 'integer' THEN '[+-]?[0-9]+' ELSE '[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?' END) THEN 'value is not a number'
       ELSE 'value out of range' END AS reason
FROM k WHERE NOT coalesce(good, false)""",
    "p3_found": _AXES + " SELECT axis, file_id, idx FROM s WHERE n * 50 >= (SELECT count(*) FROM nonzeros)",
    "p3_sums": _AXES + " SELECT * FROM s",
}
