"""Statistics: accumulation, merging, reports and JSON, as aggregates over (name, value) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import units
from weftline.sources.tables import literal_rows

EXACT = "decimal(18,2)"


def accumulate(events: DataFrame, name: str = "name", value: str = "value", exact: bool = True) -> DataFrame:
    """``name, count, value, max`` per name. Exact: values are summed as decimals, so their order can't show."""
    total = F.sum(F.col(value).cast(EXACT)).cast("double") if exact else F.sum(F.col(value).cast("double"))
    return events.groupBy(F.col(name).alias("name")).agg(F.count(F.lit(1)).alias("count"), total.alias("value"), F.max(F.col(value).cast("double")).alias("max"))


def merge(*parts: DataFrame, exact: bool = True) -> DataFrame:
    """Statistics of several ranks as one: counts and values add up, maxima compete."""
    if not parts:
        raise ValueError("nothing to merge")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    total = F.sum(F.col("value").cast(EXACT)).cast("double") if exact else F.sum("value")
    return out.groupBy("name").agg(F.sum("count").alias("count"), total.alias("value"), F.max("max").alias("max"))


def copy_events(events: DataFrame, src: str = "src", dst: str = "dst", nbytes: str = "nbytes", seconds: str = "seconds", delay: str = "delay") -> DataFrame:
    """Three (name, value) rows per copy: its bytes, time and stream delay, named after both tiers."""
    stem = F.concat(F.lit("copy-"), F.lower(F.col(src)), F.lit("-to-"), F.lower(F.col(dst)))
    return _three(events, stem, nbytes, seconds, delay)


def alloc_events(events: DataFrame, tier: str = "mem_type", nbytes: str = "nbytes", seconds: str = "seconds", delay: str = "delay") -> DataFrame:
    return _three(events, F.concat(F.lit("alloc-"), F.lower(F.col(tier))), nbytes, seconds, delay)


def _three(events: DataFrame, stem: Column, nbytes: str, seconds: str, delay: str) -> DataFrame:
    rows = [F.struct(F.concat(stem, F.lit(s)).alias("name"), F.col(c).cast("double").alias("value")) for s, c in (("-bytes", nbytes), ("-time", seconds), ("-stream-delay", delay))]
    return events.select(F.inline(F.array(*rows)))


def general(x: Column) -> Column:
    """Six significant digits, as ``%g`` prints them."""
    plain = F.format_string("%.5e", x.cast("double"))
    power = F.regexp_extract(plain, r"e([+-]\d+)$", 1).cast("int")
    out = F.concat(F.regexp_replace(F.regexp_extract(plain, r"^(.*)e", 1), r"\.?0+$", ""), F.regexp_extract(plain, r"(e[+-]\d+)$", 1))
    for k in range(-4, 6):
        fixed = F.format_string(f"%.{5 - k}f", x.cast("double"))
        out = F.when(power == k, F.regexp_replace(fixed, r"\.?0+$", "") if k < 5 else fixed).otherwise(out)
    return F.when(x == 0, F.lit("0")).otherwise(out)


def default_report(count: Column, total: Column) -> Column:
    """``total``; with several events ``total (count n)``."""
    return F.concat(general(total), F.when(count > 1, F.concat(F.lit(" (count "), count.cast("string"), F.lit(")"))).otherwise(F.lit("")))


def bytes_report(count: Column, total: Column) -> Column:
    """``total``; with several events, ``total | avg average``."""
    return F.concat(units.format_nbytes(total), F.when(count > 1, F.concat(F.lit(" | avg "), units.format_nbytes(total / count))).otherwise(F.lit("")))


def duration_report(count: Column, total: Column) -> Column:
    return F.concat(units.format_duration(total), F.when(count > 1, F.concat(F.lit(" | avg "), units.format_duration(total / count))).otherwise(F.lit("")))


def hit_rate_report(count: Column, total: Column) -> Column:
    """Hits are the total of a statistic whose events are the lookups."""
    return F.concat(general(total), F.lit("/"), count.cast("string"), F.lit(" (hits/lookups)"))


def memory_throughput_report(nbytes: tuple[Column, Column], seconds: tuple[Column, Column], delay: tuple[Column, Column]) -> Column:
    """Bytes, time, bytes a second and average stream delay of (count, total) each; the counts must agree."""
    (n, b), (m, t), (k, d) = nbytes, seconds, delay
    parts = (units.format_nbytes(b), F.lit(" | "), units.format_duration(t), F.lit(" | "), units.format_nbytes(b / t), F.lit("/s | avg-stream-delay "), units.format_duration(d / m))
    return F.when((n != m) | (m != k), F.raise_error(F.lit("counts of bytes, times and delays differ")).cast("string")).otherwise(F.concat(*parts))


#: Formatter by name, and how many statistics each renders.
FORMATTERS = {"default": 1, "bytes": 1, "duration": 1, "hit_rate": 1, "memory_throughput": 3}


def hit_rate(hits: Column, total: Column) -> Column:
    """Hits of all, as a percentage; null without any."""
    return F.when(total > 0, 100.0 * hits / total)


def throughput(nbytes: Column, seconds: Column, n_bytes: Column, n_seconds: Column) -> Column:
    """Bytes a second; the numbers of events behind either sum must agree."""
    return F.when(n_bytes != n_seconds, F.raise_error(F.lit("counts of bytes and times differ")).cast("double")).otherwise(F.when(seconds > 0, nbytes / seconds))


def report(stats: DataFrame, entries: dict[str, list[str]], formats: dict[str, Column] | None = None, enabled: bool = True) -> DataFrame:
    """``line`` per report entry and per statistic that no entry claims, by name.

    ``entries`` maps a label to the statistics it needs; where one is missing the line says that no data was
    collected. Labels are padded to the longest and three more.
    """
    spark = stats.sparkSession
    if not enabled:
        return spark.range(1).select(F.lit("Statistics: disabled.").alias("line"))
    claimed = {n for names in entries.values() for n in names}
    wanted = spark.createDataFrame([(k, n) for k, names in entries.items() for n in names], "label string, name string")
    found = wanted.join(stats, "name", "left").groupBy("label").agg((F.count("count") == F.count(F.lit(1))).alias("whole"), F.max_by("count", "name").alias("count"), F.max_by("value", "name").alias("value"), F.max_by("max", "name").alias("max"))
    rest = stats.where(~F.col("name").isin(list(claimed))).select(F.col("name").alias("label"), F.lit(True).alias("whole"), "count", "value", "max")
    shown = F.when(~F.col("whole"), F.lit("No data collected")).otherwise(_render(formats or {}))
    rows = found.unionByName(rest)
    # A line per statistic name: few, and the widest of them is one number.
    width = rows.agg(F.coalesce(F.max(F.length("label")), F.lit(0))).first()[0]
    lines = rows.select("label", F.concat(F.lit(" - "), F.rpad(F.concat("label", F.lit(":")), width + 3, " "), shown).alias("line"))
    return lines.orderBy("label").select("line")


def _render(formats: dict[str, Column]) -> Column:
    plain = F.call_function("format_number", F.col("value"), F.lit("0.######"))
    out = plain
    for label, shown in formats.items():
        out = F.when(F.col("label") == label, shown).otherwise(out)
    return out


def report_lines(stats: DataFrame, entries: dict[str, tuple[str, list[str]]]) -> DataFrame:
    """``label, line`` per report entry, rendered by its formatter, and per statistic that no whole entry claims.

    ``entries`` maps a label to a formatter's name and the statistics it renders, in order. An entry one of whose
    statistics is missing says so and claims nothing. A row per statistic name: few, however many events there were.
    """
    for label, (kind, names) in entries.items():
        if len(names) != FORMATTERS.get(kind, -1):
            raise ValueError(f"{label!r}: no formatter {kind!r} of {len(names)} statistics")
    wanted = literal_rows(stats.sparkSession, "label string, kind string, pos int, name string", [(k, kind, i, n) for k, (kind, names) in entries.items() for i, n in enumerate(names)])
    parts = F.sort_array(F.collect_list(F.struct("pos", "count", "value")))
    found = wanted.join(stats, "name", "left").groupBy("label", "kind").agg((F.count("count") == F.count(F.lit(1))).alias("whole"), parts.alias("parts"), F.collect_list("name").alias("names"))
    claimed = found.where("whole").select(F.explode("names").alias("name"))
    alone = stats.join(claimed, "name", "left_anti").select(F.col("name").alias("label"), F.lit("default").alias("kind"), F.lit(True).alias("whole"), F.array(F.struct(F.lit(0).alias("pos"), "count", "value")).alias("parts"))
    rows = found.drop("names").unionByName(alone)
    part = [(F.get("parts", F.lit(i))["count"], F.get("parts", F.lit(i))["value"]) for i in range(3)]
    shown = F.when(~F.col("whole"), F.lit("No data collected")).when(F.col("kind") == "memory_throughput", memory_throughput_report(*part))
    for kind, render in (("bytes", bytes_report), ("duration", duration_report), ("hit_rate", hit_rate_report)):
        shown = shown.when(F.col("kind") == kind, render(*part[0]))
    width = rows.agg(F.coalesce(F.max(F.length("label")), F.lit(0)).alias("width"))
    lines = rows.withColumn("shown", shown.otherwise(default_report(*part[0]))).join(F.broadcast(width))  # one row
    return lines.select("label", F.concat(F.lit(" - "), F.rpad(F.concat("label", F.lit(":")), F.col("width") + 3, F.lit(" ")), "shown").alias("line"))


def memory_lines(records: DataFrame) -> DataFrame:
    """``name, peak, line`` per memory record (name, num_calls, peak, global_peak, total, max)."""
    cells = [F.lpad(F.col("num_calls").cast("string"), 8, " "), *(F.lpad(units.format_nbytes(F.col(c)), 12, " ") for c in ("peak", "global_peak", "total", "max"))]
    return records.select("name", "peak", F.concat(*cells, F.lit("  "), "name").alias("line"))


# What stands around the lines of a report.
MEMORY_TITLE = "Memory Profiling\n----------------\n"
MEMORY_LEGEND = """Legends:
  ncalls - number of times the scope was executed.
  peak   - peak memory usage by the scope.
  g-peak - global peak memory usage during the scope's execution.
  accum  - total accumulated memory allocations by the scope.
  max    - largest single allocation by the scope.

Ordered by: peak (descending)

"""
MEMORY_HEAD = "  ncalls        peak      g-peak       accum         max  filename:lineno(name)\n"
MEMORY_END = "\nLimitation:\n  - A scope only tracks allocations made by the thread that entered it.\n"


def report_text(stats: DataFrame, entries: dict[str, tuple[str, list[str]]], records: DataFrame | None = None, enabled: bool = True, header: str = "Statistics:") -> DataFrame:
    """The whole report as one ``text``: the header, lines by label, and the memory records by falling peak."""
    if not enabled:
        return stats.sparkSession.range(1).select(F.lit(f"{header} disabled.").alias("text"))
    lines = report_lines(stats, entries)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("label", "line"))), lambda x: F.concat(x["line"], F.lit("\n"))), "")
    head = lines.agg(F.concat(F.lit(f"{header}\n"), text, F.lit("\n" + MEMORY_TITLE)).alias("text"))
    if records is None:
        return head.select(F.concat("text", F.lit("Disabled")).alias("text"))
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("peak")).alias("below"), "name", "line")))
    body = memory_lines(records).agg(F.array_join(F.transform(ordered, lambda x: F.concat(x["line"], F.lit("\n"))), "").alias("body"))
    return head.join(F.broadcast(body)).select(F.concat("text", F.lit(MEMORY_LEGEND + MEMORY_HEAD), "body", F.lit(MEMORY_END)).alias("text"))  # one row each


def json_number(x: Column) -> Column:
    """A double's shortest digits: plain from 0.0001 to below 10^16, with a signed exponent of two digits or more beyond."""
    x = x.cast("double")
    # 16 digits before the point and 20 after it hold every digit of what is written plainly.
    plain = F.regexp_replace(F.regexp_replace(x.cast("decimal(38,20)").cast("string"), r"0+$", ""), r"\.$", ".0")
    parts = [F.regexp_extract(x.cast("string"), r"^(-?\d)\.(\d+)E(-?)(\d+)$", k) for k in range(1, 5)]
    digits = F.when(parts[1] == "0", parts[0]).otherwise(F.concat_ws(".", parts[0], parts[1]))
    power = F.concat(F.when(parts[2] == "", F.lit("+")).otherwise(parts[2]), F.when(F.length(parts[3]) < 2, F.lpad(parts[3], 2, "0")).otherwise(parts[3]))
    size = F.abs(x)
    # NaN and infinity have no number in JSON and stay strings.
    out = F.when(F.isnan(x) | (size == float("inf")), F.concat(F.lit('"'), x.cast("string"), F.lit('"')))
    return out.when(x == 0, x.cast("string")).when((size >= 1e-4) & (size < 1e16), plain).when(x.isNotNull(), F.concat(digits, F.lit("e"), power))


def as_json(stats: DataFrame) -> DataFrame:
    """All statistics as one JSON object by name; names that JSON would have to escape are refused, nulls are left out."""
    bad = F.col("name").isNull() | F.col("name").rlike(r'["\\\x00-\x1f]')
    safe = F.when(bad, F.raise_error(F.lit("a statistic's name is not safe in JSON")).cast("string")).otherwise(F.col("name"))
    shown = {"count": F.col("count").cast("string"), "value": json_number(F.col("value")), "max": json_number(F.col("max"))}
    fields = F.concat_ws(",", *(F.concat(F.lit(f'"{k}":'), v) for k, v in shown.items()))
    entries = F.sort_array(F.collect_list(F.struct(safe.alias("name"), F.concat(F.lit('":{'), fields, F.lit("}")).alias("stat"))))
    return stats.agg(F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(F.lit('"'), e["name"], e["stat"])), ","), F.lit("}")).alias("json"))
