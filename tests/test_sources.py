from pyspark.sql import functions as F

from fieldspark.sources.sinks import read_stage, write_csv, write_stage


def test_stage_round_trip_partitioned(spark, tmp_path):
    df = spark.createDataFrame([("Per capita", 1, 0.5), ("Per community", 2, 1.5)],
                               "data_level string, draw long, total double")
    out = str(tmp_path / "posts")
    write_stage(df, out, ["data_level"])
    back = read_stage(spark, out)
    assert sorted(back.columns) == ["data_level", "draw", "total"]
    assert back.where(F.col("data_level") == "Per community").first()["total"] == 1.5


def test_csv_sink_quotes_strings_only(spark, tmp_path):
    df = spark.createDataFrame([('a "b", c', 1.5, 3), (None, None, 4)], "s string, v double, n int")
    out = str(tmp_path / "t")
    write_csv(df, out, quote_strings=True)
    lines = [ln for p in (tmp_path / "t").glob("part-*.csv") for ln in p.read_text().splitlines()]
    assert lines[0] == '"s","v","n"' and '"a ""b"", c",1.5,3' in lines and "NA,NA,4" in lines
    write_csv(df.orderBy("n"), str(tmp_path / "u"), order_by=["-n"])
    lines = [ln for p in (tmp_path / "u").glob("part-*.csv") for ln in p.read_text().splitlines()]
    assert lines[:2] == ["s,v,n", "NA,NA,4"]
