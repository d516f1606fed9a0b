import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from gridloom.operators import bad_rows, heavy_keys

LINES = "raw_id bigint, file_id int, line_no bigint, line string"
FILES = "file_id int, field string, n_rows bigint, n_cols bigint, delim string"
SHAPES = [(1, "real", 100, 50, ","), (2, "integer", 100, 50, ";"), (3, "pattern", 100, 50, "\t"), (4, "double", 100, 50, "|"), (5, "complex", 100, 50, ","), (6, None, 9, 9, ","), (7, "real", 9, 9, None), (8, "real", None, 9, ","), (9, "real", 9, 9, " "), (9, "real", 99, 9, " "), (None, "real", 9, 9, ",")]

GOOD = [
    (1, "1,2,3.5,note", (1, 2, 3.5, None, "note")), (1, " 007 , 50 , -1e3 ,", (7, 50, -1000.0, None, "")), (1, '"1","2","+.5","a ""q"" , b"', (1, 2, 0.5, None, 'a "q" , b')),
    (1, "1,1,5.,x\ny", (1, 1, 5.0, None, "x\ny")), (1, "1,1,1e-999,u", (1, 1, 0.0, None, "u")), (1, '" 3 ",1,0,""', (3, 1, 0.0, None, "")),
    (2, "100;50;-9223372036854775808;n", (100, 50, -(2.0**63), -(2**63), "n")), (2, "1;1;+007;%", (1, 1, 7.0, 7, "%")), (2, "1;1;-0;", (1, 1, 0.0, 0, "")),
    (3, "1\t1\tnote, with | all", (1, 1, None, None, "note, with | all")), (3, "0000000000000000000000000000001\t1\t", (1, 1, None, None, "")),
    (4, "1|1|2E+2|é", (1, 1, 200.0, None, "é")), (9, "1 1 2 x", (1, 1, 2.0, None, "x")),
]
BAD = [
    (1, None, "null line"), (42, "1,1,1,x", "unknown file"), (None, "1,1,1,x", "unknown file"), (5, "1,1,1,x", "unsupported field"), (6, "1,1,1,x", "unsupported field"), (7, "1,1,1,x", "no delimiter"),
    (1, '1,1,1,"', "broken quoting"), (1, '1,1,1,a"b', "broken quoting"), (1, '1,1,1,"a"b', "broken quoting"), (1, '1,"1,1,x', "broken quoting"), (1, '1, "1",1,x', "broken quoting"), (1, '1,1,1,"a""', "broken quoting"),
    (1, "1,1,1", "wrong number of cells"), (1, "1,1,1,x,y", "wrong number of cells"), (3, "1\t1", "wrong number of cells"), (3, "1\t1\t1\tx", "wrong number of cells"), (1, "", "wrong number of cells"), (1, " % ,1", "wrong number of cells"),
    (1, "x,1,1,n", "row is not a number"), (1, ",1,1,n", "row is not a number"), (1, "+1,1,1,n", "row is not a number"), (1, "１,1,1,n", "row is not a number"), (1, "\t1,1,1,n", "row is not a number"), (1, "0,1,1,n", "row out of range"), (1, "101,1,1,n", "row out of range"), (1, "9" * 5000 + ",1,1,n", "row out of range"), (8, "1,1,1,n", "row out of range"),
    (1, "1,1.0,1,n", "column is not a number"), (1, "1,51,1,n", "column out of range"), (1, "1,0,1,n", "column out of range"), (1, "1,99999999999999999999,1,n", "column out of range"),
    (1, "1,1,,n", "value is not a number"), (1, "1,1,nan,n", "value is not a number"), (1, "1,1,inf,n", "value is not a number"), (1, "1,1,0x1,n", "value is not a number"), (1, "1,1,1e,n", "value is not a number"), (1, "1,1,.,n", "value is not a number"), (1, "1,1,1e999,n", "value out of range"),
    (2, "1;1;1.0;n", "value is not a number"), (2, "1;1;9223372036854775808;n", "value out of range"), (2, "1;1;-9223372036854775809;n", "value out of range"),
]


@pytest.mark.parametrize("block", [1, 7, 64, 4096])
def test_every_kind_of_line(spark, block):
    rng, rows, want = random.Random(block), [], {}
    for n in range(3):
        for f, line, out in rng.sample(GOOD, len(GOOD)) + rng.sample(BAD, len(BAD)):
            rows.append((len(rows), f, n, line))
            want[rows[-1][0]] = out
    rows += [(10_000, 1, 0, "% comment"), (10_001, 42, 0, "%"), (10_002, None, 0, '%"')]
    rng.shuffle(rows)
    parsed = bad_rows.parse_entries(spark.createDataFrame(rows, LINES).coalesce(2), spark.createDataFrame(SHAPES, FILES), block)
    valid, rejected = bad_rows.split_entries(parsed)
    got = {r["raw_id"]: (r["row"], r["col"], r["val"], r["val_int"], r["note"]) for r in valid.collect()}
    got |= {r["raw_id"]: r["reason"] for r in rejected.collect()}
    assert got == want


def test_bulk_and_strict_agree_on_random_lines(spark):
    rng = random.Random(9)
    alphabet = ['"', '""', ",", " ", "1", "23", "-", ".", "e", "x", "\n", "7,8,9,"]
    rows = [(k, 1, k, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 9)))) for k in range(3000)]
    rows += [(9000 + k, 1, k, f'{rng.choice(["1", chr(34) + "2" + chr(34)])},3,{rng.choice(["4.5", " 6 ", chr(34) + "7" + chr(34)])},{"".join(rng.choice(alphabet) for _ in range(3))}') for k in range(3000)]
    df, files = spark.createDataFrame(rows, LINES), spark.createDataFrame(SHAPES, FILES)
    bulk = bad_rows.parse_entries(df, files, 64).collect()
    strict = {k: bad_rows.diagnose(line, 100, 50, "real", ",") for k, _, _, line in rows}
    assert {r["raw_id"]: tuple(r)[3:] for r in bulk} == strict
    assert {r["reason"] is None for r in bulk} == {True, False}


@pytest.mark.parametrize("n, share", [(0, 0), (1, 0), (1, 1), (1000, 0), (1000, 0.01), (1000, 0.3), (1000, 1)])
def test_isolated_records_are_those_that_fail(n, share):
    failed = np.random.default_rng(n).random(n) < share
    assert bad_rows.isolate(failed).tolist() == np.flatnonzero(failed).tolist()


def test_the_strict_reader_gets_little_but_bad_lines(monkeypatch):
    table = pq.read_table("/root/testdata/sf0.01/mtx_lines.parquet", columns=["raw_id", "file_id", "line_no", "line"])
    files = {r["file_id"]: r for r in pq.read_table("/root/testdata/sf0.01/mtx_files.parquet").to_pylist()}
    shapes = [files.get(f, {}) for f in table["file_id"].to_pylist()]
    for c, t in (("field", pa.string()), ("delim", pa.string()), ("n_rows", pa.int64()), ("n_cols", pa.int64())):
        table = table.append_column(c, pa.array([s.get(c) for s in shapes], t))
    table = table.append_column("known", pa.array([bool(s) for s in shapes]))
    seen, bad, diagnose = 0, 0, bad_rows.diagnose

    def counted(*x):
        nonlocal seen, bad
        out = diagnose(*x)
        seen, bad = seen + 1, bad + (out[-1] is not None)
        return out

    monkeypatch.setattr(bad_rows, "diagnose", counted)
    for b in table.combine_chunks().to_batches():
        list(bad_rows._parse_batch(b, 65536))
    assert bad and seen <= 1.05 * bad


def test_lines_empty_and_clashing(spark):
    files = spark.createDataFrame(SHAPES, FILES)
    assert bad_rows.parse_entries(spark.createDataFrame([], LINES), files).collect() == []
    one = spark.createDataFrame([(1, 1, 1, "1,1,1,n", "x", "y")], LINES + ", field string, reason string")
    assert bad_rows.parse_entries(one, files.selectExpr("*", "'z' as known")).first()["val"] == 1.0
    assert bad_rows.parse_entries(one, spark.createDataFrame([], FILES)).first()["reason"] == "unknown file"


ENTRIES = "entry_id bigint, file_id int, i bigint, j bigint, v double"


def brute(rows):
    out = defaultdict(lambda: [0, 0, 0.0])
    for _, f, i, j, v in rows:
        for axis, x in (("row", i), ("col", j)):
            if x is not None:
                t = out[axis, f, x]
                t[0] += 1
                t[1] += v is not None
                t[2] += v or 0.0
    return {k: (n, m, s if m else None) for k, (n, m, s) in out.items()}


@pytest.mark.parametrize("chunk, blocks, fan_in", [(10, 3, 32), (10, 2, 4), (1_000_000, None, 32)])
def test_sums_against_a_loop(spark, chunk, blocks, fan_in):
    rng = random.Random(4)
    rows = [(k, rng.choice([1, 2, None]), rng.choice([0, None, rng.randrange(20), 2**62]), int(rng.paretovariate(0.5)) % 2**40, rng.choice([None, rng.randrange(-50, 50) / 4])) for k in range(500)]
    df = spark.createDataFrame(rows + rows[:50], ENTRIES)
    got = heavy_keys.key_sums(df, chunk, blocks, fan_in).collect()
    assert {(r["axis"], r["file_id"], r["idx"]): (r["n"], r["n_v"], r["sum_v"]) for r in got} == brute(rows + rows[:50])
    assert len(got) == len(brute(rows + rows[:50]))


def test_the_reduction_has_levels_of_bounded_fan_in(spark):
    df = spark.range(4000).selectExpr("id as entry_id", "cast(1 as int) as file_id", "id % 50 as i", "id % 7 as j", "1.0D as v")
    deep = heavy_keys.key_sums(df, 10, 1, 8)  # 400 chunks by eight: 400, 50, 7, 1
    plan = deep._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroupsInPandas") == 3
    assert {(r["axis"], r["idx"]): (r["n"], r["sum_v"]) for r in deep.collect()} == {("row", k): (80, 80.0) for k in range(50)} | {("col", k): (n, float(n)) for k in range(7) for n in [4000 // 7 + (k < 4000 % 7)]}


def test_heavy_keys(spark):
    rows = [(k, 1, 7 if k < 20 else k, None if k % 2 else 3, None) for k in range(1000)]
    got = {(r["axis"], r["file_id"], r["idx"], r["n"]) for r in heavy_keys.heavy_keys(spark.createDataFrame(rows, ENTRIES)).collect()}
    assert got == {("row", 1, 7, 20), ("col", 1, 3, 500)}
    assert heavy_keys.heavy_keys(spark.createDataFrame([], ENTRIES)).collect() == []
    clash = spark.createDataFrame([(1, 1, 2, 3, 1.0, 9, "x")], ENTRIES + ", row int, axis string")
    assert heavy_keys.key_sums(clash).count() == 2
