import pytest
from pyspark.sql import functions as F

from weftline.functions import units
from weftline.operators import pipeline, running, statistics


def test_numbers_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(running, "BLOCK_ROWS", 7)
    rows = spark.range(500).select((F.col("id") % 3).alias("rank"), (F.col("id") * F.col("id") % 1009 - 300).alias("seq"), "id").dropDuplicates(["rank", "seq"])
    out = running.numbered(rows, ["rank"], "seq", "nth").collect()
    for rank in range(3):
        own = sorted((r["seq"], r["nth"]) for r in out if r["rank"] == rank)
        assert [n for _, n in own] == list(range(len(own)))
    assert running.numbered(rows.where("false"), ["rank"], "seq", "nth").count() == 0


@pytest.mark.parametrize(("x", "shown"), [(4.0, "4"), (-2.5, "-2.5"), (0.0, "0"), (123456.0, "123456"), (1234567.0, "1.23457e+06"), (0.0001, "0.0001"), (0.00001234, "1.234e-05"), (100000.0, "100000"), (3.14159265, "3.14159")])
def test_general(spark, x, shown):
    assert spark.range(1).select(statistics.general(F.lit(x))).first()[0] == shown == f"{x:g}"


def test_report_text(spark):
    stats = spark.createDataFrame([("a", 2, 4.0, 3.0), ("copy-bytes", 2, 2048.0, 1.0), ("copy-time", 2, 2.0, 1.0), ("copy-delay", 2, 0.5, 1.0), ("hit", 8, 6.0, 1.0)], "name string, count bigint, value double, max double")
    entries = {"copy": ("memory_throughput", ["copy-bytes", "copy-time", "copy-delay"]), "hits": ("hit_rate", ["hit"]), "none": ("bytes", ["a", "zz"][1:])}
    text = statistics.report_text(stats, entries).first()[0]
    assert text == "Statistics:\n - a:     4 (count 2)\n - copy:  2 KiB | 2 s | 1 KiB/s | avg-stream-delay 250 ms\n - hits:  6/8 (hits/lookups)\n - none:  No data collected\n\nMemory Profiling\n----------------\nDisabled"
    records = spark.createDataFrame([("one", 3, 1024, 2048, 4096, 512), ("two", 1, 4096, 4096, 4096, 4096)], "name string, num_calls bigint, peak bigint, global_peak bigint, total bigint, max bigint")
    lines = statistics.report_text(stats, {}, records).first()[0].split("\n")
    assert lines[lines.index("  ncalls        peak      g-peak       accum         max  filename:lineno(name)") + 1 :][:2] == ["       1       4 KiB       4 KiB       4 KiB       4 KiB  two", "       3       1 KiB       2 KiB       4 KiB       512 B  one"]
    assert statistics.report_text(stats, {}, enabled=False).first()[0] == "Statistics: disabled."
    with pytest.raises(ValueError):
        statistics.report_lines(stats, {"x": ("bytes", ["a", "b"])})


def test_ceil_div_of_large_numbers(spark):
    rows = [((1 << 62) + 1, 2), (7, 7), (8, 7), (0, 3), ((1 << 63) - 1, 1)]
    got = spark.createDataFrame(rows, "a bigint, b bigint").select(units.ceil_div(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == [-(-a // b) for a, b in rows]


def test_sinks_fail_as_a_group(spark, tmp_path):
    context = pipeline.Context(spark)
    good = pipeline.define_actor(lambda context: context.spark.range(5))
    bad = pipeline.define_actor(lambda context: context.spark.range(5).select(F.raise_error(F.lit("no")).alias("x")))
    network = pipeline.Network(context).add("good", good).add("bad", bad)
    with pytest.raises(ExceptionGroup, match="sinks failed"):
        network.run({"good": str(tmp_path / "good"), "bad": str(tmp_path / "bad")})
    assert network.run({"good": str(tmp_path / "again")}) == {"good": 5}
