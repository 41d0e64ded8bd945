"""Statistics, memory, spilling, reservation and unit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import units
from weftline.operators import memory_records, reservation, spill_policy, spill_report, statistics
from weftline.sources.tables import literal_rows, table
from weftline.streaming import structured


def _size():
    return F.octet_length("props").cast("bigint")


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events")


def stat_accumulate(spark, sf_dir):
    return statistics.accumulate(_events(spark, sf_dir), "event_type")


def stat_merge(spark, sf_dir):
    events = _events(spark, sf_dir)
    return statistics.merge(*(statistics.accumulate(events.where(F.col("user_id") % 3 == k), "event_type") for k in range(3)))


def stat_report_bytes(spark, sf_dir):
    sent = _events(spark, sf_dir).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(_size()).alias("s"))
    return sent.select("event_type", statistics.bytes_report(F.col("n"), F.col("s")).alias("report"))


def stat_copy_events(spark, sf_dir):
    events = _events(spark, sf_dir).select(F.lit("DEVICE").alias("src"), F.when(F.col("event_id") % 2 == 0, "HOST").otherwise("PINNED_HOST").alias("dst"), _size().alias("nbytes"), F.lit(0.5).alias("seconds"), F.lit(0.25).alias("delay"))
    return statistics.accumulate(statistics.copy_events(events))


def stat_report_lines(spark, sf_dir):
    stats = statistics.accumulate(_events(spark, sf_dir).select("event_type", F.round("value").alias("value")), "event_type")
    return statistics.report_lines(stats, {"missing": ("bytes", ["no-such-statistic"]), "hits": ("hit_rate", ["click"])}).select("line")


def _copies(spark, sf_dir):
    return _events(spark, sf_dir).select(F.lit("DEVICE").alias("src"), F.lit("HOST").alias("dst"), _size().alias("nbytes"), F.lit(0.5).alias("seconds"), F.lit(0.25).alias("delay"))


def stat_report_text(spark, sf_dir):
    events = _events(spark, sf_dir).select(F.col("event_type").alias("name"), F.round("value").alias("value"))
    stats = statistics.accumulate(events.unionByName(statistics.copy_events(_copies(spark, sf_dir))))
    copied = [f"copy-device-to-host-{x}" for x in ("bytes", "time", "stream-delay")]
    return statistics.report_text(stats, {"copied": ("memory_throughput", copied), "clicked": ("bytes", ["click"]), "viewed": ("duration", ["view"]), "missing": ("default", ["none"])})


def stat_alloc_events(spark, sf_dir):
    events = _events(spark, sf_dir).select(F.when(F.col("event_id") % 2 == 0, "HOST").otherwise("PINNED_HOST").alias("mem_type"), _size().alias("nbytes"), F.lit(0.5).alias("seconds"), F.lit(0.25).alias("delay"))
    return statistics.accumulate(statistics.alloc_events(events))


def memory_report_lines(spark, sf_dir):
    records = memory_records.scope_records(_deltas(spark, sf_dir))
    named = records.select(F.concat(F.lit("scope "), F.col("scope").cast("string")).alias("name"), (F.col("n_alloc") + F.col("n_dealloc")).alias("num_calls"), "peak", F.col("peak").alias("global_peak"), "total", "max")
    return statistics.memory_lines(named).select("name", "line")


def stat_json(spark, sf_dir):
    return statistics.as_json(statistics.accumulate(_events(spark, sf_dir).select("event_type", F.floor("value").alias("value")), "event_type"))


def stat_throughput(spark, sf_dir):
    rows = _events(spark, sf_dir).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(_size()).alias("s"))
    return rows.select("event_type", statistics.throughput(F.col("s").cast("double"), F.col("n") * 0.5, F.col("n"), F.col("n")).alias("per_second"), statistics.hit_rate(F.col("n"), 2 * F.col("n")).alias("hit_rate"))


def streaming_stats(spark, sf_dir):
    """The accumulate query as a stream over the table's files, run to their end."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
    stream = reader.parquet(path) if _is_folder(spark, path) else reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    name = f"running_stats_{abs(hash(sf_dir)) % 10**8}"
    return structured.table_of(structured.running_stats(stream, "event_type", "value"), name)


def _is_folder(spark, path):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()


def _deltas(spark, sf_dir):
    sign = F.when(F.col("event_type").isin("purchase", "view", "click"), _size()).otherwise(-_size())
    return _events(spark, sf_dir).select(F.col("user_id").alias("scope"), F.col("event_id").alias("t"), sign.alias("delta"))


def memory_peak(spark, sf_dir):
    return memory_records.scope_records(_deltas(spark, sf_dir))


def memory_scope_merge(spark, sf_dir):
    records = memory_records.scope_records(_deltas(spark, sf_dir))
    return memory_records.add_scopes(records.withColumn("rank", F.col("scope") % 3), ["rank"])


def memory_subscope(spark, sf_dir):
    rows = _deltas(spark, sf_dir)
    parents = memory_records.scope_records(rows.where("scope % 2 = 0").withColumn("scope", F.expr("scope div 2")))
    children = memory_records.scope_records(rows.where("scope % 2 = 1").withColumn("scope", F.expr("scope div 2")))
    return memory_records.add_subscope_columns(parents, children, "scope")


def _objects(spark, sf_dir):
    kind = F.when(F.col("event_id") % 3 == 0, "DEVICE").otherwise("HOST")
    return _events(spark, sf_dir).select(F.col("event_id").alias("id"), (F.col("user_id") % 4).alias("rank"), kind.alias("mem_type"), _size().alias("nbytes"), (F.col("event_id") % 10).alias("pid"))


def spill_fifo(spark, sf_dir):
    return spill_policy.fifo(_objects(spark, sf_dir), 500, partition_by=["rank"]).select("rank", "id", "nbytes", "spilled_before")


def spill_by_tier(spark, sf_dir):
    return spill_policy.by_tier(_objects(spark, sf_dir), 500, partition_by=["rank"]).select("rank", "id", "nbytes")


def spill_received_chunks(spark, sf_dir):
    return spill_policy.received_chunks(_objects(spark, sf_dir), 700, chunk_id="id", partition_by=["rank"]).select("rank", "pid", "id", "nbytes")


def spill_priority(spark, sf_dir):
    functions = _events(spark, sf_dir).select((F.col("user_id") % 4).alias("rank"), F.col("event_id").alias("registered"), (F.col("user_id") % 5 - 2).alias("priority"), _size().alias("can_spill"))
    return spill_policy.priority_cascade(functions, 400, partition_by=["rank"]).select("rank", "registered", "priority", "asked", "spilled")


def spill_best_fit(spark, sf_dir):
    return spill_policy.best_fit(_objects(spark, sf_dir), 300, partition_by=["rank"]).select("rank", "place", "id", "nbytes")


def reservation_order(spark, sf_dir):
    requests = _events(spark, sf_dir).select((F.col("user_id") % 4).alias("rank"), F.col("event_id").alias("seq"), _size().alias("size"), (F.col("user_id") % 7 - 3).alias("net_memory_delta"))
    return reservation.next_granted(requests, 40, ["rank"])


def reservation_forced(spark, sf_dir):
    requests = _events(spark, sf_dir).select((F.col("user_id") % 4).alias("rank"), F.col("event_id").alias("seq"), _size().alias("size"), (F.col("user_id") % 7 - 3).alias("net_memory_delta"))
    return reservation.forced(requests, ["rank"])


def reservation_overbooking(spark, sf_dir):
    requests = _events(spark, sf_dir).select("event_id", F.lit(64).alias("available"), (F.col("event_id") % 32).alias("reserved"), _size().alias("size"))
    return reservation.reserve(requests).select("event_id", "overbooked", "granted")


def reservation_tiers(spark, sf_dir):
    tier = reservation.first_fitting_tier(_size(), {"DEVICE": F.col("event_id") % 40, "PINNED_HOST": F.col("user_id") % 60, "HOST": F.lit(45)})
    return _events(spark, sf_dir).select("event_id", tier.alias("tier"))


def spill_trace(spark, sf_dir):
    events = _events(spark, sf_dir)
    inline = F.col("event_id") % 2 == 0
    trace = events.select((F.col("event_id") * 1000).alias("start"), (F.col("event_id") * 1000 + F.col("user_id")).alias("end"), F.when(inline, F.col("event_type")).alias("text"), F.when(~inline, F.col("user_id") % 3).alias("text_id"), _size().alias("payload"))
    strings = literal_rows(spark, "id bigint, value string", [(0, "click"), (1, "purchase"), (2, "other")])
    return spill_report.analyze(trace, strings, "click", "purchase").withColumn("std", F.round("std", 6))


def spill_ratios(spark, sf_dir):
    return spill_report.ratios(spill_trace(spark, sf_dir)).select(F.round("satisfaction_pct", 6).alias("satisfaction_pct"), F.round("bytes_per_second", 3).alias("bytes_per_second"))


def format_sizes(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", units.format_nbytes(F.col("event_id") * 1000).alias("size"))


def format_durations(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", units.format_duration(F.col("event_id") * 0.5).alias("duration"))


def parse_sizes(spark, sf_dir):
    k = F.col("event_id")
    unit = F.element_at(F.array(*(F.lit(u) for u in ("B", " KiB", "kb", " MiB", "GB", "", "x"))), (k % 7 + 1).cast("int"))
    return _events(spark, sf_dir).select("event_id", units.parse_nbytes(F.concat((k % 1000).cast("string"), unit)).alias("nbytes"))


def parse_percents(spark, sf_dir):
    text = F.concat((F.col("event_id") % 101).cast("string"), F.lit(".5 %"))
    return _events(spark, sf_dir).select("event_id", units.parse_nbytes_or_percent(text, F.lit(1000)).alias("nbytes"))


def parse_durations(spark, sf_dir):
    unit = F.element_at(F.array(*(F.lit(u) for u in (" s", "min", " h", "d", "", "mins"))), (F.col("event_id") % 6 + 1).cast("int"))
    return _events(spark, sf_dir).select("event_id", units.parse_duration(F.concat((F.col("event_id") % 90).cast("string"), unit)).alias("seconds"))


def parse_words(spark, sf_dir):
    text = F.element_at(F.array(*(F.lit(u) for u in ("Yes", "off", "42", "0", "none", "maybe"))), (F.col("event_id") % 6 + 1).cast("int"))
    return _events(spark, sf_dir).select("event_id", units.parse_bool(text).alias("flag"), units.parse_optional(text).alias("kept"), F.size(units.parse_string_list(F.concat(text, F.lit(", ,b")))).cast("bigint").alias("tokens"))


def parse_lists(spark, sf_dir):
    text = F.element_at(F.array(*(F.lit(u) for u in ("a,b", " a , ,b ", "", "one", "x,"))), (F.col("event_id") % 5 + 1).cast("int"))
    return _events(spark, sf_dir).select("event_id", F.array_join(units.parse_string_list(text), "|").alias("tokens"))


def parse_optional_sizes(spark, sf_dir):
    text = F.element_at(F.array(*(F.lit(u) for u in ("1 KiB", "disabled", "2MB", "none", "7"))), (F.col("event_id") % 5 + 1).cast("int"))
    return _events(spark, sf_dir).select("event_id", units.parse_optional_nbytes(text).alias("nbytes"))


QUERIES = {
    f.__name__: f
    for f in (
        stat_accumulate, stat_merge, stat_report_bytes, stat_copy_events, stat_alloc_events, stat_report_lines, stat_report_text, memory_report_lines, parse_lists, parse_optional_sizes, stat_json, stat_throughput, streaming_stats, memory_peak,
        memory_scope_merge, memory_subscope, spill_fifo, spill_by_tier, spill_received_chunks, spill_priority, spill_best_fit, reservation_order, reservation_forced,
        reservation_overbooking, reservation_tiers, spill_trace, spill_ratios, format_sizes, format_durations, parse_sizes, parse_percents, parse_durations, parse_words,
    )
}

_EXACT = "CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE)"
_STATS = f"SELECT event_type AS name, count(*) AS count, {_EXACT} AS value, max(value) AS max FROM events GROUP BY 1"


def _bytes_text(x):
    steps = "".join(f"WHEN {x} < {1024.0 ** (k + 1)} THEN regexp_replace(printf('%.2f', {x} / {1024.0**k}), '\\.0+$', '') || ' {u}' " for k, u in enumerate(units.BINARY_UNITS))
    return f"(CASE {steps} END)"


def _duration_text(x):
    steps = "".join(f"WHEN {x} >= {s} THEN regexp_replace(printf('%.2f', {x} / {s}), '\\.0+$', '') || ' {u}' " for u, s in (("d", 86400.0), ("h", 3600.0), ("min", 60.0), ("s", 1.0)))
    small = f"WHEN {x} >= 0.001 THEN regexp_replace(printf('%.2f', {x} * 1000), '\\.0+$', '') || ' ms' ELSE '0 s'"
    return f"(CASE {steps} {small} END)"


_DELTAS = "(SELECT user_id AS scope, event_id AS t, CAST(CASE WHEN event_type IN ('purchase', 'view', 'click') THEN strlen(props) ELSE -strlen(props) END AS BIGINT) AS delta FROM events)"
_RECORDS = f"""(SELECT scope, CAST(sum(delta) AS BIGINT) AS current, CAST(greatest(0, max(level)) AS BIGINT) AS peak, CAST(coalesce(sum(delta) FILTER (delta > 0), 0) AS BIGINT) AS total,
    coalesce(max(delta) FILTER (delta > 0), 0) AS max, count(*) FILTER (delta > 0) AS n_alloc, count(*) FILTER (delta < 0) AS n_dealloc
    FROM (SELECT *, sum(delta) OVER (PARTITION BY scope ORDER BY t ROWS UNBOUNDED PRECEDING) AS level FROM {_DELTAS}) GROUP BY 1)"""
_OBJECTS = "(SELECT event_id AS id, user_id % 4 AS rank, CASE WHEN event_id % 3 = 0 THEN 'DEVICE' ELSE 'HOST' END AS mem_type, strlen(props) AS nbytes, event_id % 10 AS pid FROM events)"
_REQUESTS = "(SELECT user_id % 4 AS rank, event_id AS seq, strlen(props) AS size, user_id % 7 - 3 AS net_memory_delta FROM events)"
_TRACE = """(SELECT coalesce(text, s) AS name, d, payload FROM (SELECT user_id AS d, CASE WHEN event_id % 2 = 0 THEN event_type END AS text, CASE WHEN event_id % 2 = 1 THEN user_id % 3 END AS text_id, strlen(props) AS payload FROM events) e
    LEFT JOIN (VALUES (0, 'click'), (1, 'purchase'), (2, 'other')) v(i, s) ON text IS NULL AND text_id = i)"""
_METRICS = f"""(SELECT 'duration' AS metric, d AS x FROM {_TRACE} WHERE name = 'click' UNION ALL SELECT 'requested', payload FROM {_TRACE} WHERE name = 'click' UNION ALL SELECT 'spilled', payload FROM {_TRACE} WHERE name = 'purchase')"""


def _window(source, order, amount, extra=""):
    return f"(SELECT *, CAST(coalesce(sum(nbytes) OVER (PARTITION BY rank ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS spilled_before FROM {source} {extra})"


def _nested(scopes):
    return _RECORDS.replace(_DELTAS, f"(SELECT scope // 2 AS scope, t, delta FROM {_DELTAS} WHERE scope % 2 = {scopes})")


ORACLES = {
    "stat_accumulate": _STATS,
    "stat_merge": _STATS,
    "streaming_stats": _STATS,
    "stat_report_bytes": f"SELECT event_type, {_bytes_text('s')} || CASE WHEN n > 1 THEN ' | avg ' || {_bytes_text('(s / n)')} ELSE '' END AS report FROM (SELECT event_type, count(*) AS n, sum(strlen(props)) AS s FROM events GROUP BY 1)",
    "stat_copy_events": """WITH e AS (SELECT 'copy-device-to-' || CASE WHEN event_id % 2 = 0 THEN 'host' ELSE 'pinned_host' END AS stem, strlen(props) AS b FROM events)
        SELECT name, count(*) AS count, CAST(sum(CAST(v AS DECIMAL(18,2))) AS DOUBLE) AS value, max(v) AS max FROM (SELECT stem || '-bytes' AS name, CAST(b AS DOUBLE) AS v FROM e UNION ALL SELECT stem || '-time', 0.5 FROM e UNION ALL SELECT stem || '-stream-delay', 0.25 FROM e) GROUP BY 1""",
    "stat_report_lines": """WITH s AS (SELECT name AS label, printf('%g', value) || CASE WHEN count > 1 THEN ' (count ' || count || ')' ELSE '' END AS shown FROM (SELECT event_type AS name, count(*) AS count, CAST(sum(round(value)) AS DOUBLE) AS value FROM events GROUP BY 1) WHERE name <> 'click'
        UNION ALL SELECT 'hits', printf('%g', CAST(sum(round(value)) AS DOUBLE)) || '/' || count(*) || ' (hits/lookups)' FROM events WHERE event_type = 'click' UNION ALL SELECT 'missing', 'No data collected')
        SELECT ' - ' || rpad(label || ':', CAST((SELECT max(length(label)) FROM s) + 3 AS INT), ' ') || shown AS line FROM s""",
    "stat_report_text": f"""WITH e AS (SELECT event_type AS name, count(*) AS n, CAST(sum(round(value)) AS DOUBLE) AS v FROM events GROUP BY 1), c AS (SELECT count(*) AS n, CAST(sum(strlen(props)) AS DOUBLE) AS b FROM events),
        s AS (SELECT name AS label, printf('%g', v) || CASE WHEN n > 1 THEN ' (count ' || n || ')' ELSE '' END AS shown FROM e WHERE name NOT IN ('click', 'view')
        UNION ALL SELECT 'clicked', {_bytes_text('v')} || CASE WHEN n > 1 THEN ' | avg ' || {_bytes_text('(v / n)')} ELSE '' END FROM e WHERE name = 'click'
        UNION ALL SELECT 'viewed', {_duration_text('v')} || CASE WHEN n > 1 THEN ' | avg ' || {_duration_text('(v / n)')} ELSE '' END FROM e WHERE name = 'view'
        UNION ALL SELECT 'copied', {_bytes_text('b')} || ' | ' || {_duration_text('(n * 0.5::DOUBLE)')} || ' | ' || {_bytes_text('(b / (n * 0.5::DOUBLE))')} || '/s | avg-stream-delay 250 ms' FROM c
        UNION ALL SELECT 'missing', 'No data collected')
        SELECT 'Statistics:' || chr(10) || string_agg(' - ' || rpad(label || ':', CAST((SELECT max(length(label)) FROM s) + 3 AS INT), ' ') || shown || chr(10), '' ORDER BY label) || chr(10) || 'Memory Profiling' || chr(10) || '----------------' || chr(10) || 'Disabled' AS text FROM s""",
    "stat_alloc_events": """WITH e AS (SELECT 'alloc-' || CASE WHEN event_id % 2 = 0 THEN 'host' ELSE 'pinned_host' END AS stem, strlen(props) AS b FROM events)
        SELECT name, count(*) AS count, CAST(sum(CAST(v AS DECIMAL(18,2))) AS DOUBLE) AS value, max(v) AS max FROM (SELECT stem || '-bytes' AS name, CAST(b AS DOUBLE) AS v FROM e UNION ALL SELECT stem || '-time', 0.5 FROM e UNION ALL SELECT stem || '-stream-delay', 0.25 FROM e) GROUP BY 1""",
    "memory_report_lines": f"SELECT 'scope ' || scope AS name, lpad(CAST(n_alloc + n_dealloc AS VARCHAR), 8, ' ') || lpad({_bytes_text('peak')}, 12, ' ') || lpad({_bytes_text('peak')}, 12, ' ') || lpad({_bytes_text('total')}, 12, ' ') || lpad({_bytes_text('max')}, 12, ' ') || '  scope ' || scope AS line FROM {_RECORDS}",
    "parse_lists": "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'a|b' WHEN 1 THEN 'a||b' WHEN 2 THEN '' WHEN 3 THEN 'one' ELSE 'x|' END AS tokens FROM events",
    "parse_optional_sizes": "SELECT event_id, CAST(CASE event_id % 5 WHEN 0 THEN 1024 WHEN 2 THEN 2000000 WHEN 4 THEN 7 END AS BIGINT) AS nbytes FROM events",
    "stat_json": f"""SELECT '{{' || string_agg('"' || name || '":{{"count":' || count || ',"value":' || CAST(value AS VARCHAR) || ',"max":' || CAST(max AS VARCHAR) || '}}', ',' ORDER BY name) || '}}' AS json
        FROM (SELECT event_type AS name, count(*) AS count, CAST(sum(floor(value)) AS DOUBLE) AS value, CAST(max(floor(value)) AS DOUBLE) AS max FROM events GROUP BY 1)""",
    "stat_throughput": "SELECT event_type, CAST(sum(strlen(props)) AS DOUBLE) / (count(*) * 0.5) AS per_second, 50.0::DOUBLE AS hit_rate FROM events GROUP BY 1",
    "memory_peak": f"SELECT * FROM {_RECORDS}",
    "memory_scope_merge": f"SELECT scope % 3 AS rank, CAST(sum(current) AS BIGINT) AS current, max(peak) AS peak, CAST(sum(total) AS BIGINT) AS total, max(max) AS max, CAST(sum(n_alloc) AS BIGINT) AS n_alloc, CAST(sum(n_dealloc) AS BIGINT) AS n_dealloc FROM {_RECORDS} GROUP BY 1",
    "memory_subscope": f"SELECT p.scope, p.current + coalesce(c.current, 0) AS current, greatest(p.peak, p.current + coalesce(c.peak, 0)) AS peak, p.total + coalesce(c.total, 0) AS total, greatest(p.max, coalesce(c.max, 0)) AS max FROM {_nested(0)} p LEFT JOIN {_nested(1)} c ON p.scope = c.scope",
    "spill_fifo": f"SELECT rank, id, nbytes, spilled_before FROM {_window(_OBJECTS, 'id', 500)} WHERE spilled_before < 500",
    "spill_by_tier": f"SELECT rank, id, nbytes FROM {_window(_OBJECTS, 'id', 500, chr(39).join(['WHERE mem_type = ', 'DEVICE', '']))} WHERE spilled_before < 500",
    "spill_received_chunks": f"SELECT rank, pid, id, nbytes FROM {_window(_OBJECTS, 'pid, id', 700, 'WHERE nbytes > 0')} WHERE spilled_before < 700",
    "spill_priority": f"SELECT rank, registered, priority, CAST(400 - spilled_before AS BIGINT) AS asked, nbytes AS spilled FROM {_window('(SELECT user_id % 4 AS rank, event_id AS registered, user_id % 5 - 2 AS priority, strlen(props) AS nbytes FROM events)', 'priority DESC, registered', 400)} WHERE spilled_before < 400",
    "reservation_order": f"SELECT * FROM {_REQUESTS} WHERE size <= 40 QUALIFY row_number() OVER (PARTITION BY rank ORDER BY net_memory_delta, size, seq) = 1",
    "reservation_forced": f"SELECT * FROM {_REQUESTS} QUALIFY row_number() OVER (PARTITION BY rank ORDER BY size, net_memory_delta, seq) = 1",
    "reservation_overbooking": "SELECT event_id, greatest(0, event_id % 32 + strlen(props) - 64) AS overbooked, CASE WHEN event_id % 32 + strlen(props) > 64 THEN 0 ELSE strlen(props) END AS granted FROM events",
    "reservation_tiers": "SELECT event_id, CASE WHEN event_id % 40 >= strlen(props) THEN 'DEVICE' WHEN user_id % 60 >= strlen(props) THEN 'PINNED_HOST' WHEN 45 >= strlen(props) THEN 'HOST' END AS tier FROM events",
    "spill_trace": f"SELECT metric, count(*) AS n, CAST(sum(x) AS DOUBLE) / count(*) AS avg, round(stddev_samp(x), 6) AS std, min(x) AS min, max(x) AS max, CAST(sum(x) AS BIGINT) AS total FROM {_METRICS} GROUP BY 1",
    "spill_ratios": f"SELECT round(100.0::DOUBLE * s / r, 6) AS satisfaction_pct, round(s / (d / 1e9::DOUBLE), 3) AS bytes_per_second FROM (SELECT CAST(sum(x) FILTER (metric = 'spilled') AS DOUBLE) AS s, CAST(sum(x) FILTER (metric = 'requested') AS DOUBLE) AS r, CAST(sum(x) FILTER (metric = 'duration') AS DOUBLE) AS d FROM {_METRICS})",
    "format_sizes": f"SELECT event_id, {_bytes_text('(event_id * 1000)')} AS size FROM events",
    "format_durations": f"SELECT event_id, {_duration_text('(event_id * 0.5::DOUBLE)')} AS duration FROM events",
    "parse_sizes": "SELECT event_id, CASE event_id % 7 WHEN 0 THEN 1 WHEN 1 THEN 1024 WHEN 2 THEN 1000 WHEN 3 THEN 1048576 WHEN 4 THEN 1000000000 WHEN 5 THEN 1 END * (event_id % 1000) AS nbytes FROM events",
    "parse_percents": "SELECT event_id, 10 * (event_id % 101 + 1) AS nbytes FROM events",
    "parse_durations": "SELECT event_id, (event_id % 90) * CASE event_id % 6 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 60 WHEN 2 THEN 3600 WHEN 3 THEN 86400 WHEN 4 THEN 1 END AS seconds FROM events",
    "parse_words": "SELECT event_id, CASE event_id % 6 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false END AS flag, CASE event_id % 6 WHEN 0 THEN 'Yes' WHEN 2 THEN '42' WHEN 3 THEN '0' WHEN 5 THEN 'maybe' END AS kept, CAST(3 AS BIGINT) AS tokens FROM events",
    "spill_best_fit": f"""WITH RECURSIVE c AS (SELECT rank, id, nbytes FROM {_OBJECTS} WHERE nbytes > 0),
        t AS (SELECT rank, CAST(0 AS BIGINT) AS place, id, nbytes, 300 - nbytes AS left_over FROM c
            QUALIFY row_number() OVER (PARTITION BY rank ORDER BY nbytes < 300, CASE WHEN nbytes >= 300 THEN nbytes ELSE -nbytes END, CASE WHEN nbytes >= 300 THEN id ELSE -id END) = 1
        UNION ALL SELECT t.rank, place + 1, x.id, x.nbytes, left_over - x.nbytes FROM t, LATERAL (SELECT * FROM c WHERE c.rank = t.rank AND (c.nbytes, c.id) < (t.nbytes, t.id)
            ORDER BY nbytes < left_over, CASE WHEN nbytes >= left_over THEN nbytes ELSE -nbytes END, CASE WHEN nbytes >= left_over THEN id ELSE -id END LIMIT 1) x WHERE left_over > 0)
        SELECT rank, place, id, nbytes FROM t""",
}
