"""Readers, sinks and streams on small files."""

import pytest
from pyspark.sql import functions as F

from sievelode.operators import quality
from sievelode.sources import readers
from sievelode.streaming import streams


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_source_tree(spark, tmp_path):
    for name, text in (("a.py", "x = 1\ny = 2\n"), ("d/b.py", ""), ("node_modules/c.py", "z"), ("d/e.txt", "no")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    got = {r.path.rsplit("/", 1)[1]: r.src for r in readers.source_tree(spark, str(tmp_path)).collect()}
    assert got.get("a.py") == "x = 1\ny = 2\n" and "c.py" not in got and "e.txt" not in got


def test_triples(spark, tmp_path):
    (tmp_path / "t.nt").write_text('# c\n\n<a> <p> <b> .\n<b> <p> "x . y"@en .\n_:n <p> <gone> . # end\nbroken\n')
    t = readers.ntriples(spark, str(tmp_path / "t.nt"))
    assert rows_of(t) == [("<a>", "<p>", "<b>"), ("<b>", "<p>", '"x . y"@en'), ("_:n", "<p>", "<gone>")]
    assert rows_of(readers.dangling_objects(t)) == [("_:n", "<p>", "<gone>")]


def test_rows_json_and_front_matter(spark, tmp_path):
    (tmp_path / "r.csv").write_text('a,b\n1,"x ""q"", y"\n2,\n')
    assert rows_of(readers.string_rows(spark, str(tmp_path / "r.csv"))) == [("1", 'x "q", y'), ("2", None)]
    (tmp_path / "r.json").write_text('[{"a": 1}, {"b": 2}]')
    assert rows_of(readers.json_rows(spark, str(tmp_path / "r.json"), "a int, b int")) == [(1, None), (None, 2)]
    df = spark.createDataFrame([("---\nname: x: y\n bad\nname: z\nk:v\n---\nbody",), ("no",), (None,)], "t string").select(readers.front_matter(F.col("t")).alias("m"))
    assert [r.m for r in df.collect()] == [{"name": "x: y", "k": "v"}, {}, None]
    text = 'x\ndependencies = [\n  "a[z]>=1",\n  \'b-c\'\n]\ninstall_requires=["d"]\n'
    assert spark.createDataFrame([(text,)], "t string").select(readers.declared_packages(F.col("t"))).first()[0] == ["a", "b-c", "d"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("g", i) for i in range(5)] + [("h", 9)], "k string, i int")
    readers.write_capped(df, str(tmp_path / "c"), ["k"], [F.desc("i")], 2)
    assert rows_of(spark.read.parquet(str(tmp_path / "c")).select("k", "i")) == [("g", 3), ("g", 4), ("h", 9)]
    with pytest.raises(ValueError):
        readers.write_snapshot(df, str(tmp_path / "s"), ["k"])


def test_streams(spark, tmp_path):
    rows = [(1, "2024-01-01 01:00:00", "a", 1.0), (2, "2024-01-01 02:00:00", "a", 2.0), (3, "2024-01-03 05:00:00", "a", 4.0)]
    df = spark.createDataFrame(rows, "event_id long, ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    df.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    stream = streams.file_stream(spark, str(tmp_path), "events")
    got = streams.run_to_table(streams.windowed_counts(stream), "t").collect()
    assert [(r.n, r.total) for r in got] == [(2, 3.0)]
    twice = df.select((F.col("event_id") % 2).alias("k"), "ts")
    twice.coalesce(1).write.parquet(str(tmp_path / "keys.parquet"))
    once = streams.once_per_key(streams.file_stream(spark, str(tmp_path), "keys"), ["k"], "ts")
    assert rows_of(streams.run_to_table(once, "o").select("k")) == [(0,), (1,)]


def test_quality(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, -1)], "id int, v int")
    assert rows_of(quality.expectations(df, {"pos": "v > 0", "id": "id > 0"})) == [("id", 0, 3), ("pos", 2, 3)]
    assert rows_of(quality.violations(df, "id", {"pos": "v > 0"})) == [(2, "pos"), (3, "pos")]
    assert rows_of(quality.expectations(df.limit(0), {"pos": "v > 0"})) == [("pos", 0, 0)]
    text = spark.createDataFrame([(1, "'abcdef' 'abcdef' 'ghijkl' 'abcdef' 'ghijkl' 'ghijkl'"), (2, None)], "k int, t string")
    assert rows_of(quality.repeated_literals(text, "k", "t", top=1)) == [(1, "abcdef", 3)]


def test_batches_are_folded_and_state_kept(spark, tmp_path):
    rows = [(1, 7, "2024-01-01 01:00:00", "a"), (2, 7, "2024-01-03 02:00:00", "b"), (3, 7, "2024-01-02 05:00:00", "c"), (4, 8, "2024-01-02 05:00:00", "d"), (5, None, "2024-01-02 05:00:00", "e")]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts string, event_type string").withColumn("ts", F.col("ts").cast("timestamp"))
    for i in range(3):  # three files, three batches
        df.where(F.col("event_id") % 3 == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    batches = []

    def step(old, batch):
        batches.append(1)
        return old.unionByName(batch.select("user_id", F.lit(1).cast("long").alias("n"))).groupBy("user_id").agg(F.sum("n").alias("n"))

    folded = streams.fold(streams.file_stream(spark, str(tmp_path), "events", 1), "f", "user_id long, n long", step)
    assert rows_of(folded) == sorted([(7, 3), (8, 1), (None, 1)], key=str) and len(batches) == 3
    given = streams.run_to_table(streams.latest_by_key(streams.file_stream(spark, str(tmp_path), "events", 1), "user_id", "ts", "event_id", "event_type"), "k").collect()
    last = {k: max((r.n, r.last) for r in given if r.user_id == k) for k in (7, 8)}
    assert last == {7: (3, "b"), 8: (1, "d")}
