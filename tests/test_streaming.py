import os

from gridloom.operators.bad_rows import parse_entries
from gridloom.sources.tables import table
from gridloom.streaming import entries

FOLDER = "/root/testdata/sf0.001"


def run(spark, stream, mode, tmp_path):
    q = stream.writeStream.format("memory").queryName(f"out_{mode}").outputMode(mode).option("checkpointLocation", str(tmp_path / mode)).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(f"out_{mode}")


def source(spark, name, tmp_path):
    at = str(tmp_path / name)
    df = table(spark, FOLDER, name)
    df.repartition(3).write.parquet(at)
    return spark.readStream.schema(df.schema).parquet(at)


def test_a_stream_of_lines_parses_as_a_batch(spark, tmp_path):
    files = table(spark, FOLDER, "mtx_files")
    got = run(spark, entries.parse_stream(source(spark, "mtx_lines", tmp_path), files), "append", tmp_path)
    want = parse_entries(table(spark, FOLDER, "mtx_lines"), files)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_windowed_degrees(spark, tmp_path):
    got = run(spark, entries.windowed_degrees(source(spark, "nonzeros", tmp_path), late="4000 days"), "update", tmp_path)
    rows = table(spark, FOLDER, "nonzeros").where("i is not null and loaded_at is not null").select("entry_id").distinct().count()
    assert got.selectExpr("sum(degree) as n").first()["n"] == rows


def test_an_entry_delivered_again_after_weeks_counts_once(spark, tmp_path):
    schema = "entry_id bigint, file_id int, i bigint, loaded_at timestamp"
    (tmp_path / "in").mkdir()
    for k, (entry, day) in enumerate([(1, "2021-03-01"), (2, "2021-04-03"), (3, "2021-04-05"), (1, "2021-04-09"), (4, "2021-04-10")]):
        at = tmp_path / "in" / f"{k}.json"
        at.write_text(f'{{"entry_id": {entry}, "file_id": 0, "i": 0, "loaded_at": "{day}T00:00:00Z"}}\n')
        os.utime(at, (1_600_000_000 + k, 1_600_000_000 + k))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    got = run(spark, entries.windowed_degrees(stream), "update", tmp_path)
    assert got.selectExpr("sum(degree) as n").first()["n"] == 4
