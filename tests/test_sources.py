"""Readers, writers and the stream extension on small files."""

import json

from pyspark.sql import functions as F

from tessera.sources import codec, tables
from tessera.streaming import windows


def test_json_round_trip(spark, tmp_path):
    (tmp_path / "high_2025.json").write_text(json.dumps({"records": [{"name": "b", "n": 1}, {"name": "a", "n": 2}]}))
    df = tables.read_json_records(spark, str(tmp_path / "high_2025.json"), "name string, n int")
    df = tables.from_file_names(df, "path", {"stage": r"(\w+)_\d+\.json", "year": r"_(\d+)\.json"})
    assert [tuple(r) for r in df.select("ord", "name", "n", "stage", "year").orderBy("ord").collect()] == [(0, "b", 1, "high", "2025"), (1, "a", 2, "high", "2025")]
    tables.write_json_sorted(df.select("name", "n"), str(tmp_path / "out"), ["name"])
    lines = next((tmp_path / "out").glob("part-*")).read_text().splitlines()
    assert [json.loads(x)["name"] for x in lines] == ["a", "b"] and list(json.loads(lines[0])) == ["n", "name"]


def test_csv_by_category(spark, tmp_path):
    df = spark.createDataFrame([("x", "a,\n\"q\""), ("y", None)], "kind string, text string")
    tables.write_csv(df, str(tmp_path / "out"), by="kind")
    back = tables.read_csv(spark, str(tmp_path / "out/kind=x"), "text string")
    assert back.first().text == "a,\n\"q\""


def test_html_tables(spark):
    html = "<table><tr><th>h</th></tr></table><table><tr><td>1</td><td> <b>a</b>&nbsp;b </td></tr><script>x</script><tr><td>2</td></tr></table>"
    df = spark.createDataFrame([(1, html), (2, "none"), (3, None)], "id int, html string")
    assert [r.cells for r in tables.nth_table(df, "id", "html", 1).orderBy("row_no").collect()] == [["1", "a b"], ["2"]]
    rows = tables.html_rows(df, "id", "html").filter(tables.wide_enough("cells", 2, "^h"))
    assert rows.count() == 1
    one = rows.select(*tables.positional("cells", ["no", "name", "gone"])).first()
    assert tuple(one) == ("1", "a b", None)


def test_words_and_polygons(spark):
    words = spark.createDataFrame([(1, 5.0, 10.1, "b"), (1, 1.0, 9.6, "a"), (1, 1.0, 30.0, "c")], "page int, x double, y double, text string")
    assert sorted(r.text for r in tables.words_to_rows(words, "page", "x", "y", "text").collect()) == ["ab", "c"]
    df = spark.createDataFrame([("1,2;3,4;5,6|1,2;x,4",), (None,)], "t string")
    assert [r.p for r in df.select(tables.polygon("t").alias("p")).collect()] == [[[[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]]], None]


def test_catalogue(spark, sf):
    c = tables.Catalogue(spark, sf, ["nation", "nothing"])
    assert c.missing() == ["nothing"] and c.read("nation").count() == 25


def test_codec_keeps_null(spark):
    df = spark.createDataFrame([(1, "b"), (2, None), (3, "a"), (4, "b")], "k int, v string")
    codes = codec.dictionary(df, "v", "k")
    assert {r.v: r.code for r in codes.collect()} == {"b": 0, "a": 1}
    assert {r.k: r.v for r in codec.decode(codec.encode(df, "v", codes), "v", codes).collect()} == {1: "b", 2: None, 3: "a", 4: "b"}
    nested = spark.createDataFrame([(1, ("x", "y"))], "k int, s struct<a:string,b:string>")
    assert codec.trim(nested, ["k"], {"s": ["b"]}).columns == ["s"]


def test_stream_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = windows.stream_folder(spark, str(tmp_path / "in"), events.schema.simpleString()[7:-1].replace(":", " "), 10)
    out = windows.tumbling(stream, "ts", "1 hour", "event_type", "value", "1 second")
    windows.run_available(out, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {tuple(r) for r in windows.tumbling(events, "ts", "1 hour", "event_type", "value").collect()}
    assert got <= want and len(want - got) <= 10  # the last windows are not final yet
