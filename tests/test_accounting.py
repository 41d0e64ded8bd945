import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from weftline.functions import config, units
from weftline.operators import memory_records, reservation, spill_policy, spill_report, statistics
from weftline.sources import messages
from weftline.streaming import structured


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, x {kind}")
    return [r[0] for r in rows.orderBy("k").select(f(F.col("x"))).collect()]


def test_format_nbytes(spark):
    values = [0, 1, 1023, 1024, 1536, -1536, 1 << 20, 1 << 30, 5 * (1 << 40), 1 << 50]
    assert column(spark, values, units.format_nbytes, "bigint") == ["0 B", "1 B", "1023 B", "1 KiB", "1.50 KiB", "-1.50 KiB", "1 MiB", "1 GiB", "5 TiB", "1 PiB"]


def test_format_duration(spark):
    values = [0.0, 1.0, 90.0, 3600.0, 86400.0, 0.5, 2e-6, 3e-9, 1e-12, -90.0]
    assert column(spark, values, units.format_duration, "double") == ["0 s", "1 s", "1.50 min", "1 h", "1 d", "500 ms", "2 us", "3 ns", "0 s", "-1.50 min"]


def test_parse_nbytes(spark):
    texts = ["1 KiB", "1kb", "1.5 MiB", "7", "-2 B", "2.5", "-2.5", "1e3", "1 XB", "", "KiB", None]
    expected = [1024, 1000, 1572864, 7, -2, 3, -3, 1000, None, None, None, None]
    assert column(spark, texts, units.parse_nbytes) == expected
    for text, value in zip(texts, expected, strict=True):
        if value is None and text is not None:
            with pytest.raises(ValueError):
                config.text_nbytes(text)
        elif text is not None:
            assert config.text_nbytes(text) == value
    assert column(spark, ["12.5%", "50 %", "1 KB", "-1%"], lambda x: units.parse_nbytes_or_percent(x, F.lit(1000))) == [130, 500, 1000, None]


def test_parse_duration(spark):
    texts = ["1", "2 ms", "3min", "4 m", "1 h", "1d", "5us", "6 µs", "7 ns", "sec", "1 mins", "1 month", "nan", "inf"]
    expected = [1.0, 2e-3, 180.0, 240.0, 3600.0, 86400.0, 5e-6, 6e-6, 7e-9, *[None] * 5]
    assert column(spark, texts, units.parse_duration) == pytest.approx(expected)


def test_parse_words(spark):
    assert column(spark, ["42", "0", "TRUE", " on ", "No", "maybe"], units.parse_bool) == [True, False, True, True, False, None]
    assert column(spark, ["disabled", "N/A", "5"], units.parse_optional) == [None, None, "5"]
    assert column(spark, ["a, b,,c", "  ", ","], units.parse_string_list) == [["a", "b", "", "c"], [], ["", ""]]


def test_options():
    options = config.Options({"Limit": "80%"})
    assert not options.insert_if_absent("LIMIT", "1")
    assert config.Options.deserialize(options.serialize()).strings() == {"limit": "80%"}
    with pytest.raises(ValueError):
        config.Options.deserialize(options.serialize()[:-1] + b"x")
    assert options.get("limit") == "80%" and options.get("num_streams", int) == 16
    with pytest.raises(KeyError):
        options.get("Limit")
    with pytest.raises(ValueError):
        options.get("num_streams", str)
    with pytest.raises(ValueError):
        options.serialize()
    assert config.from_environment(r"W_(\w+)", {"W_A": "1", "XW_B": "2"}) == {"A": "1"}
    with pytest.raises(ValueError):
        config.from_environment("W_.*", {})


def test_statistics(spark):
    events = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", -2.0)], "name string, value double")
    stats = statistics.accumulate(events)
    assert sorted(map(tuple, stats.collect())) == [("a", 2, 4.0, 3.0), ("b", 1, -2.0, -2.0)]
    assert sorted(map(tuple, statistics.merge(stats, stats).collect())) == [("a", 4, 8.0, 3.0), ("b", 2, -4.0, -2.0)]
    with pytest.raises(ValueError):
        statistics.merge()
    lines = [r["line"] for r in statistics.report(stats, {"longer": ["zz"]}).collect()]
    assert lines == [" - a:       4", " - b:       -2", " - longer:  No data collected"]
    assert "disabled" in statistics.report(stats, {}, enabled=False).first()["line"]
    with pytest.raises(Exception, match="not safe"):
        statistics.as_json(spark.createDataFrame([('a"', 1, 1.0, 1.0)], "name string, count long, value double, max double")).collect()


def test_json_of_large_statistics(spark):
    """Totals of ten millions and more, as tables of 1 GB have them, are written as the SQL writes them."""
    numbers = [0.0, 5.0, -2.5, 9999999.0, 1e7, 12345678.0, -25000000.0, 10000000.5, 123456789012.0, 9999999999999998.0, 1e16, -1.2345678901234568e16, 1.5e22, 1e300, 0.001, 0.00012345, 1e-4, 1e-5, 1.2345e-7]
    rows = spark.createDataFrame([(f"n{k:02}", k, x, -x) for k, x in enumerate(numbers)], "name string, count long, value double, max double")
    con = duckdb.connect()
    want = [con.execute("select cast(?::double as varchar), cast(?::double as varchar)", [x, -x]).fetchall()[0] for x in numbers]
    text = statistics.as_json(rows).first()["json"]
    assert text == "{" + ",".join(f'"n{k:02}":{{"count":{k},"value":{value},"max":{most}}}' for k, (value, most) in enumerate(want)) + "}"
    assert {k: v["value"] for k, v in json.loads(text).items()} == {f"n{k:02}": x for k, x in enumerate(numbers)}
    odd = spark.createDataFrame([("a", 1, None, float("inf"))], rows.schema)
    assert statistics.as_json(odd).first()["json"] == '{"a":{"count":1,"max":"Infinity"}}'
    assert statistics.as_json(rows.where("false")).first()["json"] == "{}"


def test_memory_records(spark):
    events = [("s", 0, 10), ("s", 1, 5), ("s", 2, -10), ("s", 3, 7), ("f", 0, -4)]
    out = {r["scope"]: r for r in memory_records.scope_records(spark.createDataFrame(events, "scope string, t int, delta int")).collect()}
    assert tuple(out["s"])[1:] == (12, 15, 22, 10, 3, 1) and out["f"]["peak"] == 0
    one, other = out["s"].asDict(), out["f"].asDict()
    assert memory_records.add_subscope(one, other)["peak"] == 15


def test_spill_policies(spark):
    rows = spark.createDataFrame([(k, "DEVICE" if k < 2 else "HOST", 10) for k in range(4)], "id int, mem_type string, nbytes int")
    assert [r["id"] for r in spill_policy.by_tier(rows, 100).orderBy("id").collect()] == [0, 1]
    assert [r["id"] for r in spill_policy.fifo(rows, 11).orderBy("id").collect()] == [0, 1]
    with pytest.raises(ValueError):
        spill_policy.fifo(rows, -1)
    sizes = spark.createDataFrame([(k, n) for k, n in enumerate([1, 5, 8, 20, 3])], "id int, nbytes int")

    def taken(amount):
        return [(r["id"], r["nbytes"]) for r in spill_policy.best_fit(sizes, amount).orderBy("place").collect()]

    assert taken(6) == [(2, 8)] and taken(23) == [(3, 20), (4, 3)] and taken(0) == []
    assert taken(100) == [(3, 20), (2, 8), (1, 5), (4, 3), (0, 1)]
    functions = spark.createDataFrame([(0, 0, 5), (1, 2, 3), (2, 2, 4)], "registered int, priority int, can_spill int")
    assert [(r["registered"], r["asked"]) for r in spill_policy.priority_cascade(functions, 6).orderBy("spilled_before").collect()] == [(1, 6), (2, 3)]


@pytest.mark.parametrize("seed", range(6))
def test_best_fit_against_the_walk(spark, seed):
    rng = random.Random(seed)
    sizes, amount = [rng.randint(1, 12) for _ in range(10)], rng.randint(1, 60)
    rows, left, want = sorted((n, k) for k, n in enumerate(sizes)), amount, []
    while left > 0 and rows:
        chosen = next((x for x in rows if x[0] >= left), rows[-1])
        rows.remove(chosen)
        want.append(chosen[1])
        left -= chosen[0]
    found = spill_policy.best_fit(spark.createDataFrame(list(enumerate(sizes)), "id int, nbytes int"), amount)
    assert [r["id"] for r in found.orderBy("place").collect()] == want


def test_reservations(spark):
    rows = spark.createDataFrame([(0, 10, 2), (1, 10, 1), (2, 30, 0)], "seq int, size int, net_memory_delta int").withColumn("m", F.lit(0))
    assert reservation.next_granted(rows, 20, ["m"]).first()["seq"] == 1
    assert reservation.next_granted(rows, 5, ["m"]).count() == 0
    assert reservation.forced(rows, ["m"]).first()["seq"] == 1
    asked = spark.createDataFrame([(100, 90, 20)], "available int, reserved int, size int")
    assert tuple(reservation.reserve(asked).first())[3:] == (10, 0)
    assert tuple(reservation.reserve(asked, allow_overbooking=True).first())[3:] == (10, 20)
    for bad in (-1, 1.5, True):
        with pytest.raises(ValueError):
            reservation.check_size(bad)


def test_spill_report(spark):
    events = spark.createDataFrame([(0, 10, "spill", None, 100), (0, 30, None, 7, 50), (5, 5, None, 8, 120), (1, 2, None, 99, 1)], "start long, end long, text string, text_id long, payload long")
    strings = spark.createDataFrame([(7, "spill"), (8, "gain")], "id long, value string")
    out = {r["metric"]: r for r in spill_report.analyze(events, strings, "spill", "gain").collect()}
    assert (out["duration"]["total"], out["requested"]["total"], out["spilled"]["total"]) == (40, 150, 120) and out["spilled"]["std"] is None
    assert spill_report.ratios(spill_report.analyze(events, strings, "spill", "gain")).first()["satisfaction_pct"] == pytest.approx(80.0)


def test_sources(spark, tmp_path):
    sent = messages.push(spark, ["a", "b"], first=3)
    assert [tuple(r) for r in messages.pull(sent)] == [(3, "a"), (4, "b")] and messages.checked_sequence(sent)
    with pytest.raises(ValueError):
        messages.push(spark, [None])
    (tmp_path / "m.csv").write_text("timestamp,free_memory_bytes,total_memory_bytes,used_memory_bytes\n0.5,10,20,10\n1.5,5,20,15\n")
    assert tuple(messages.memory_sample_summary(messages.memory_samples(spark, str(tmp_path / "m.csv"))).first()) == (2, 10, 15, 1.0)
    (tmp_path / "t.json").write_text('{"system": {"hostname": "h"}, "gpus": [{"id": 0, "numa_node": 1, "network_devices": ["n0", "n1"]}], "network_devices": []}')
    assert messages.device_neighbours(messages.topology(spark, str(tmp_path / "t.json"))).count() == 2


def test_streaming(spark, tmp_path):
    rows = spark.range(40).select((F.col("id") % 3).cast("string").alias("name"), F.col("id").cast("double").alias("value"))
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = structured.source(spark, str(tmp_path / "in"), rows.schema, tickets=1)
    paths = [str(tmp_path / "one"), str(tmp_path / "other")]
    structured.fanout(stream, paths, str(tmp_path / "cp")).awaitTermination()
    assert [spark.read.parquet(p).count() for p in paths] == [40, 40]
    with pytest.raises(ValueError):
        structured.fanout(stream, paths[:1], str(tmp_path / "cp2"))
    out = structured.table_of(structured.running_stats(stream, "name", "value"), "running")
    assert sorted((r["name"], r["count"]) for r in out.collect()) == [("0", 14), ("1", 13), ("2", 13)]
    seen = []
    structured.drain(stream, lambda batch, number: seen.append(batch.count()), str(tmp_path / "cp3"))
    assert sum(seen) == 40 and len(seen) > 1
