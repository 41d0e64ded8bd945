"""Fuzzy line de-duplication by MinHash, in DataFrame operations alone.

A line's shingles of eight characters are sampled: those that start with one of a few fixed characters, so that which
count depends on their own text alone; where these are few, all count. The least distinct hashes are the signature, and
each three neighbours of it, sorted, are a band. Lines that share a band are compared by the Jaccard similarity of all
their five-character shingles; links become components by a distributed union-find, and the first line of each
component stays. Equal lines are one line from the start. Bitmaps of the shingles' parities come before the texts: they
differ in no more bits than the sets in shingles, so what they rule out is not alike for certain.

A line is first compared with the first line that it shares a band with. Where that leaves a band's lines in several
components, all pairs between components are compared: by their bitmaps in all groups but the largest, and there where
their rarest shingles meet, of which lines that are alike share one for certain (prefix filter). So no pair that shares
a band is left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm import _shared

SHINGLE = 5
#: What follows one of the characters whose code is 4 modulo 8. Scripts without them have all their shingles counted.
SAMPLED = r"(?s)[$,4<\\dlt|](?=(.{7}))"
EIGHT = r"(?s)(?=(.{8}))"
EVERY = r"(?s)(?=(.{5}))"
LEAST_CHARS = 20
#: Lines with fewer sampled shingles are known by all of theirs, those with still fewer by these alone.
FEW, FEWEST = 18, 12
BAND = 3
#: Lines of each group that its other lines are compared with first, and of each rare shingle.
HUBS, RARE_HUBS = 2, 3
#: Larger groups of a band are compared as families: as one where their hubs are of one component.
SMALL_GROUP = 128
#: Larger families are split by rare shingles: so many bitmaps are compared in about the time that a line's shingles take to make.
LARGE_GROUP = 8192
SIMILAR = 0.8
#: Words of 64 bits of a line's bitmap; lines with ``LONG`` shingles or more have eight bitmaps, with eight times as many sixty-four.
WORDS, LONG = 16, 1000
#: Words of what goes with a line into the join of all pairs, as it goes there once for each of its keys.
FOLDED = 4


def normalized(line: Column) -> Column:
    return F.lower(F.trim(line))


def identity(line: Column) -> list[Column]:
    """128 bits of two hashes with different seeds: equal lines, and for all practical sizes only those, are one."""
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit("again"), line).alias("h2")]


def least_hashes(strings: Column, size: int) -> Column:
    """The least distinct hashes of 32 bits, sorted."""
    return F.slice(F.sort_array(F.array_distinct(F.transform(strings, lambda x: F.shiftright(F.xxhash64(x), 32).cast("int")))), 1, size)


def signatures(lines: DataFrame, size: int) -> DataFrame:
    """``lines`` with ``sig``, of the sampled shingles, and ``more``, of all where the sampled are few; null otherwise."""
    found = lines.withColumn("some", F.regexp_extract_all("line", F.lit(SAMPLED), F.lit(1)))
    every = F.regexp_extract_all("line", F.lit(EIGHT), F.lit(1))
    return found.select(*lines.columns, F.when(F.size("some") >= FEWEST, least_hashes(F.col("some"), size)).alias("sig"), F.when(F.size("some") < FEW, least_hashes(every, size)).alias("more"))


def windows(sig: Column, width: int) -> Column:
    """A hash of each ``width`` neighbours."""
    n = F.greatest(F.size(sig) - (width - 1), F.lit(0))
    out = F.slice(sig, F.lit(1), n)
    for k in range(1, width):
        out = F.zip_with(out, F.slice(sig, F.lit(k + 1), n), lambda a, b: F.xxhash64(a, b))
    return out


def bands(sig: Column, size: int) -> Column:
    """Windows of three; of a signature that isn't full also those of two, of the shortest the whole. None of null."""
    short = F.when(F.size(sig) < BAND, F.array(F.xxhash64(sig))).otherwise(F.concat(windows(sig, BAND), F.when(F.size(sig) < size, windows(sig, 2)).otherwise(F.array().cast("array<bigint>"))))
    return F.when(sig.isNotNull(), short).otherwise(F.array().cast("array<bigint>"))


def shingles(line: Column) -> Column:
    """64-bit hashes of all shingles of five characters, repeats included; of the line itself where it is shorter."""
    every = F.transform(F.regexp_extract_all(line, F.lit(EVERY), F.lit(1)), lambda x: F.xxhash64(x))
    return F.when(F.char_length(line) < SHINGLE, F.array(F.xxhash64(line))).otherwise(every)


def _keyed(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.withColumn("row", F.xxhash64("doc_id", "text"))


def dropped_lines(docs: DataFrame, similar: float = SIMILAR, least_chars: int = LEAST_CHARS, size: int = 12) -> DataFrame:
    """``doc_id, row, dropped``: the numbers (from 0) of each document's lines that go; documents that lose none aren't listed.

    Lines are what ``\\n`` separates, compared without the white space around them and without case. Lines of fewer
    than ``least_chars`` characters are never dropped. Of a component's lines that with the smallest doc_id and line
    number stays; null doc_ids come first. ``row`` is a 64-bit hash of doc_id and text and tells apart rows that
    share a doc_id; rows that repeat both are one document. Null and empty texts have no line to drop, nor has an
    empty table. The result is a table of its own; all others are removed before this returns.
    """
    with _shared.scratch(docs.sparkSession):
        return _shared.written(_dropped_lines(docs, similar, least_chars, size), "dropped-lines", outlives=True)[0]


def _dropped_lines(docs: DataFrame, similar: float, least_chars: int, size: int) -> DataFrame:
    texts = _keyed(docs)
    lines = texts.select("doc_id", "row", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("line", normalized(F.col("line")))
    lines = lines.where(F.char_length("line") >= least_chars).select(*identity(F.col("line")), F.struct("doc_id", "line_no", "row").alias("at"), "line")
    found, _ = _shared.written(signatures(lines, size).drop("line"), "lines")
    unique = found.groupBy("h1", "h2").agg(F.min("at").alias("at"), F.max("at").alias("last"), F.first("sig").alias("sig"), F.first("more").alias("more"))
    unique = unique.select(F.monotonically_increasing_id().alias("n"), "h1", "h2", "at", (F.col("at") != F.col("last")).alias("copied"), "sig", "more")
    unique, _ = _shared.written(unique, "unique-lines")

    # Dealt once: counted and joined where they are. The counts have a row per key, so they are hashed and nothing is sorted.
    keys = unique.select("n", F.explode(F.array_distinct(F.concat(bands(F.col("sig"), size), bands(F.col("more"), size)))).alias("key")).repartition("key")
    ends = keys.groupBy("key").agg(F.min("n").alias("low"), F.count(F.lit(1)).alias("lines")).where("lines > 1")
    groups, _ = _shared.written(keys.join(ends.hint("shuffle_hash"), "key"), "line-groups")

    wanted = groups.select("n").distinct().join(unique.select("n", "at"), "n")
    places = wanted.groupBy(F.col("at.row").alias("row"), F.col("at.doc_id").alias("d")).agg(F.collect_list(F.struct(F.col("at.line_no").alias("line_no"), "n")).alias("places"))
    holding = texts.join(places.hint("shuffle_hash"), "row").where(F.col("doc_id").eqNullSafe(F.col("d"))).select("row", F.split("text", "\n").alias("all"), F.explode("places").alias("p"))
    # Rows that repeat doc_id and text give their lines twice, in one task.
    known = holding.select("row", F.col("p.n").alias("n"), normalized(F.get("all", F.col("p.line_no"))).alias("line")).dropDuplicates(["row", "n"]).select("n", "line")
    known, _ = _shared.written(known, "line-texts")

    joined = _all_joined(groups, known, similar)
    placed = unique.select("n", "h1", "h2", "at", "copied").join(joined, "n", "left").where(F.col("copied") | F.col("component").isNotNull())
    placed, _ = _shared.written(placed.select("h1", "h2", "at", F.coalesce("component", "n").alias("component")), "line-families")
    stays = placed.groupBy("component").agg(F.min("at").alias("at")).select(*(F.col(f"at.{c}").alias(f"{c}_") for c in ("doc_id", "line_no", "row")))
    copies = found.select("h1", "h2", "at").join(placed.select("h1", "h2").hint("shuffle_hash"), ["h1", "h2"], "left_semi").select("at.*")
    gone = copies.join(stays, (F.col("row") == F.col("row_")) & (F.col("line_no") == F.col("line_no_")) & F.col("doc_id").eqNullSafe(F.col("doc_id_")), "left_anti")
    return gone.groupBy("doc_id", "row").agg(F.sort_array(F.collect_set("line_no")).alias("dropped"))


def parities(lines: DataFrame) -> DataFrame:
    """``n, size, odd`` of lines (n, line): how many distinct shingles, and which places of a bitmap an odd number of them falls on.

    Equal shingles cancel out, so two bitmaps differ in no more bits than the sets in shingles. Longer lines have larger bitmaps.
    """
    sets = lines.select("n", F.array_distinct(shingles(F.col("line"))).alias("set"))
    parts = F.when(F.size("set") < LONG, 1).when(F.size("set") < 8 * LONG, 8).otherwise(64)
    each = sets.select("n", parts.alias("parts"), F.explode("set").alias("x"))
    each = each.select("n", F.pmod(F.shiftright("x", 40), "parts").cast("int").alias("part"), F.shiftright("x", 6).bitwiseAND(WORDS - 1).alias("word"), F.expr("shiftleft(1L, cast(x & 63 as int))").alias("bit"))
    words = [F.coalesce(F.bit_xor(F.when(F.col("word") == k, F.col("bit"))), F.lit(0)).alias(f"w{k}") for k in range(WORDS)]
    rows = each.groupBy("n", "part").agg(F.count(F.lit(1)).alias("some"), *words)
    held = F.sort_array(F.collect_list(F.struct("part", F.array(*(f"w{k}" for k in range(WORDS))).alias("words"))))
    return rows.groupBy("n").agg(F.sum("some").alias("size"), F.flatten(held["words"]).alias("odd"))


def _bits_apart(similar: float) -> Column:
    """In how many places of their bitmaps lines and their twins (columns with ``_``) differ; null where that or their sizes rule out ``similar``.

    Of lines whose bitmaps can't be compared 0: they may be alike.
    """
    bits = F.aggregate(F.zip_with("odd", "odd_", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, x: s + x)
    apart = F.when(F.size("odd") == F.size("odd_"), bits).otherwise(F.lit(0))
    least, most = F.least("size", "size_"), F.greatest("size", "size_")
    # Sets alike differ in (1 - similar) / (1 + similar) of their sizes' sum at most.
    alike = (least >= F.lit(similar - 1e-9) * most) & (apart <= F.lit((1 - similar) / (1 + similar) + 1e-9) * (least + most))
    return F.when(alike, apart)


def _near(pairs: DataFrame, sketches: DataFrame, similar: float) -> DataFrame:
    """Of pairs (n, n_) those that their bitmaps allow to be alike, as ``n, n_, bits``."""
    twins = sketches.select(*(F.col(c).alias(f"{c}_") for c in sketches.columns))
    return pairs.join(sketches, "n").join(twins, "n_").select("n", "n_", _bits_apart(similar).alias("bits")).where("bits IS NOT NULL")


def _linked(pairs: DataFrame, known: DataFrame, similar: float) -> DataFrame:
    """The pairs (n, m) of lines whose sets of shingles are alike, as u, v."""
    both = pairs.join(known, "n").join(known.select(F.col("n").alias("m"), F.col("line").alias("other")), "m")
    sets = both.select("n", "m", shingles(F.col("line")).alias("a"), shingles(F.col("other")).alias("b"))
    # Written before the filter, which would otherwise move below and evaluate the sets once for each mention.
    sizes, path = _shared.written(sets.select("n", "m", F.size(F.array_intersect("a", "b")).alias("common"), F.size(F.array_union("a", "b")).alias("all")), "line-sizes")
    return sizes.where(F.col("common") >= similar * F.col("all")).select(F.col("n").alias("u"), F.col("m").alias("v"))


def _apart(groups: DataFrame, now: DataFrame, hubs: int = 0) -> DataFrame:
    """The groups (key, n, ...) whose lines are in several components, with each line's component and size and the group's number of lines.

    Likewise so many ``hubs`` of the group, hub0, hub1, ..., and their components, of0, of1, ...: the same lines in all groups that have them.
    """
    named = groups.drop("low", "lines").join(now, "n")
    chosen = [F.min_by(c, F.xxhash64("n", F.lit(k))).alias(f"{name}{k}") for k in range(hubs) for c, name in (("n", "hub"), ("component", "of"))]
    mixed = named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("lines"), *chosen).where("low < high")
    return named.join(mixed.drop("low", "high").hint("shuffle_hash"), "key")


def _folded(sketches: DataFrame, words: int = FOLDED) -> DataFrame:
    """``n`` and each line's bitmap with its parts and words laid over one another, w0, w1, ...: parities too, and of one length for all lines."""

    def word(k: int) -> Column:
        rest = F.aggregate(F.sequence(F.lit(k), F.size("odd") - 1, F.lit(words)), F.lit(0).cast("bigint"), lambda s, i: s.bitwiseXOR(F.get("odd", i)))
        return rest.alias(f"w{k}")

    return sketches.select("n", *(word(k) for k in range(words)))


def _bits(words: range) -> Column:
    return sum((F.bit_count(F.col(f"w{k}").bitwiseXOR(F.col(f"w{k}_"))) for k in words), F.lit(0))


def _within(words: range, similar: float) -> Column:
    """Whether these words of the bitmaps of a line and its twin (columns with ``_``) differ in no more bits than in all lines alike may."""
    return _bits(words) <= F.lit((1 - similar) / (1 + similar) + 1e-9) * (F.col("size") + F.col("size_"))


def _pairs(groups: DataFrame, similar: float, ranked: bool = False) -> DataFrame:
    """``n, n_`` of each key's lines of different components (columns key, n, component, size), once each, that their sizes allow to be alike.

    Where ``groups`` have the lines' folded bitmaps (w0, ...), those must allow it too. Keys that are shingles say by ``rest`` how many of a line's shingles don't come before them (``ranked``). Two lines
    alike share one of which both have enough left for all they must share: the first they share is such.
    """
    other = groups.select("key", *(F.col(c).alias(f"{c}_") for c in groups.columns if c != "key"))
    met = (F.col("n") > F.col("n_")) & (F.col("component") != F.col("component_")) & (F.least("size", "size_") >= F.lit(similar - 1e-9) * F.greatest("size", "size_"))
    if ranked:
        met &= F.least("rest", "rest_") >= F.lit(similar / (1 + similar) - 1e-9) * (F.col("size") + F.col("size_"))
    if "w0" in groups.columns:
        met &= _within(range(FOLDED), similar)
    return groups.join(other, "key").where(met).select("n", "n_").distinct()


def _families(groups: DataFrame) -> DataFrame:
    """``key, n, component, size, lines`` of all lines of groups (key, n, component, size, of0) whose hub is of one component, which is the family's ``key``."""
    lines = groups.select(F.col("of0").alias("key"), "n", "component", "size").distinct()
    return lines.join(lines.groupBy("key").agg(F.count(F.lit(1)).alias("lines")), "key")


def _family_pairs(families: DataFrame, sketches: DataFrame, similar: float) -> DataFrame:
    """``n, m, of, bits``: each family's pairs of lines of different components that their sizes and bitmaps of ``WORDS`` words allow to be alike.

    Lines of the family's own component, its largest as a rule, are met by the others only; ``of`` is such a line.
    """
    lines = families.select("key", "n", "component", "size").join(_folded(sketches, WORDS), "n")
    other = lines.select("key", *(F.col(c).alias(f"{c}_") for c in lines.columns if c != "key"))
    met = (F.col("component") != F.col("component_")) & ((F.col("component_") == F.col("key")) | (F.col("n") > F.col("n_")))
    met &= F.least("size", "size_") >= F.lit(similar - 1e-9) * F.greatest("size", "size_")
    met &= _within(range(FOLDED), similar) & _within(range(WORDS), similar)
    found = lines.where("component <> key").join(other, "key").where(met)
    return found.select(F.greatest("n", "n_").alias("n"), F.least("n", "n_").alias("m"), F.col("n").alias("of"), _bits(range(WORDS)).alias("bits")).distinct()


def _rare(lines: DataFrame, similar: float) -> DataFrame:
    """``key, n, rest``: so many of each line's rarest shingles that two lines alike share one of them (prefix filter)."""
    sets = lines.select("n", F.array_distinct(shingles(F.col("line"))).alias("set"))
    # Dealt once, as shingles are dear: counted and joined where they are. Counting mentions all columns, or Spark would make and deal them twice.
    each = sets.select("n", F.size("set").alias("all"), F.explode("set").alias("key")).repartition("key")
    often = each.groupBy("key").agg(F.count(F.lit(1)).alias("often"), F.min("n").alias("low"), F.max("n").alias("high"), F.max("all").alias("most")).where("low < high AND most > 0").select("key", "often")
    some = each.join(often.hint("shuffle_hash"), "key").groupBy("n", "all").agg(F.sort_array(F.collect_list(F.struct("often", "key"))).alias("shared"))
    # Shingles of one line alone are the rarest of all and meet nothing.
    before = F.col("all") - F.size("shared")
    left = F.greatest(F.lit(0), F.col("all") - F.ceil(F.lit(similar - 1e-9) * F.col("all")) + 1 - before).cast("int")
    first = some.select("n", "all", before.alias("before"), F.posexplode(F.slice("shared", F.lit(1), left)).alias("at", "x"))
    return first.select("x.key", "n", (F.col("all") - F.col("before") - F.col("at")).alias("rest"))


def _merged(now: DataFrame, links: DataFrame) -> DataFrame:
    """``n, component, size`` after links between lines, which count as links of their components so far."""
    ends = links
    for end in ("u", "v"):
        ends = ends.join(now.select(F.col("n").alias(end), F.col("component").alias(f"c{end}")), end)
    found = _shared.components(ends.where("cu <> cv").select(F.col("cu").alias("u"), F.col("cv").alias("v")), "lines")
    found = found.select("node", F.col("component").alias("into"))
    return _shared.written(now.join(found, F.col("component") == F.col("node"), "left").select("n", F.coalesce("into", "component").alias("component"), "size"), "line-components")[0]


def _all_joined(groups: DataFrame, known: DataFrame, similar: float) -> DataFrame:
    """``n, component, size`` of all links among the lines of each key (columns key, n, low, lines)."""
    sketches, _ = _shared.written(parities(known), "line-parities")
    first = groups.where("n > low").select("n", F.col("low").alias("n_")).distinct()
    compared, _ = _shared.written(_near(first, sketches, similar).groupBy("n").agg(F.min_by("n_", F.struct("bits", "n_")).alias("m")), "line-pairs")
    found = _shared.components(_linked(compared, known, similar), "lines").withColumnRenamed("node", "n")
    now, _ = _shared.written(sketches.select("n", "size").join(found, "n", "left").select("n", F.coalesce("component", "n").alias("component"), "size"), "line-components")

    # What is still apart is compared with the nearest hub of its groups before all pairs are.
    now, compared = _met_hubs(groups, now, sketches, compared, known, similar, HUBS)
    folded, _ = _shared.written(_folded(sketches), "line-bitmaps")
    apart, _ = _shared.written(_apart(groups, now, 1).drop("hub0"), "groups-apart")
    pairs = _pairs(apart.where(F.col("lines") <= SMALL_GROUP).drop("lines", "of0").join(folded, "n"), similar)
    pairs = _near(pairs, sketches, similar).select("n", F.col("n_").alias("m"))
    large, _ = _shared.written(_families(apart.where(F.col("lines") > SMALL_GROUP)), "large-groups")
    if not large.isEmpty():
        met, _ = _shared.written(_family_pairs(large.where(F.col("lines") <= LARGE_GROUP), sketches, similar), "family-pairs")
        # Of a family's lines each is alike to many others: the nearest first, then what is still apart.
        now, compared = _met_nearest(met, now, compared, known, similar)
        pairs = pairs.unionByName(met.select("n", "m"))
        rare, _ = _shared.written(_rare(large.where(F.col("lines") > LARGE_GROUP).select("n").distinct().join(known, "n"), similar), "rare-shingles")
        if not rare.isEmpty():
            now, compared = _met_hubs(rare, now, sketches, compared, known, similar, RARE_HUBS)
            far = _pairs(_apart(rare, now).drop("lines").join(folded, "n"), similar, ranked=True)
            pairs = pairs.unionByName(_near(far, sketches, similar).select("n", F.col("n_").alias("m")))
        of = {end: now.select(F.col("n").alias(end), F.col("component").alias(f"c{end}")) for end in ("n", "m")}
        pairs = pairs.distinct().join(of["n"], "n").join(of["m"], "m").where("cn <> cm").select("n", "m")
    pairs, _ = _shared.written(pairs, "line-pairs")
    # What has been compared is settled either way.
    return _merged(now, _linked(pairs.join(compared, ["n", "m"], "left_anti"), known, similar))


def _met_nearest(ends: DataFrame, now: DataFrame, compared: DataFrame, known: DataFrame, similar: float) -> tuple[DataFrame, DataFrame]:
    """Of each line's pairs (n, m, of, bits) not compared yet that with the fewest bits is. Returns the components after that and all pairs compared so far."""
    near = ends.join(compared, ["n", "m"], "left_anti").groupBy("of").agg(F.min(F.struct("bits", "n", "m")).alias("pair")).select("pair.n", "pair.m").distinct()
    near, _ = _shared.written(near, "line-pairs")
    return _merged(now, _linked(near, known, similar)), compared.unionByName(near)


def _met_hubs(groups: DataFrame, now: DataFrame, sketches: DataFrame, compared: DataFrame, known: DataFrame, similar: float, hubs: int) -> tuple[DataFrame, DataFrame]:
    """Each line of groups (key, n, ...) that are still apart is compared with the nearest of their hubs, so many lines a group.

    Hubs of a family are compared with one another as well, so that it does not fall into parts. Returns the components
    after that and all pairs compared so far.
    """
    apart, _ = _shared.written(_apart(groups, now, hubs), "groups-apart")
    met = [apart.where(F.col("component") != F.col(f"of{k}")).select("n", F.col(f"hub{k}").alias("n_")) for k in range(hubs)]
    ends = _near(reduce(DataFrame.unionByName, met).repartition("n").distinct(), sketches, similar).select(F.greatest("n", "n_").alias("n"), F.least("n", "n_").alias("m"), F.col("n").alias("of"), "bits")
    return _met_nearest(ends, now, compared, known, similar)


def _matched(docs: DataFrame, dropped: str, **options) -> DataFrame:
    """``docs`` with the numbers of the lines that go in column ``dropped``."""
    row, d, r = (_shared.unused(docs, c) for c in ("row_of", "doc_id_of", "row_gone"))
    gone = dropped_lines(docs, **options).select(F.col("doc_id").alias(d), F.col("row").alias(r), F.col("dropped").alias(dropped))
    rows = docs.withColumn(row, F.xxhash64(F.col("doc_id").cast("bigint"), F.coalesce(F.col("text").cast("string"), F.lit(""))))
    return rows.join(gone, rows["doc_id"].cast("bigint").eqNullSafe(F.col(d)) & (F.col(row) == F.col(r)), "left").drop(row, d, r)


def without_repeated_lines(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with ``text`` rid of dropped lines; other columns stay as they are, whatever their names. Null texts stay null.

    Of rows that repeat doc_id and text all stay, and lose the same lines. An empty table stays empty.
    """
    columns = docs.columns
    dropped = _shared.unused(docs, "dropped")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains(F.col(dropped), i)), "\n")
    out = _matched(docs, dropped, **options)
    return out.withColumn("text", F.when(F.col(dropped).isNull(), F.col("text")).otherwise(kept)).select(*columns)


def op5_line_dedup(spark, sf_dir):
    """doc_id, n_lines, n_dropped and the numbers of dropped lines of every document.

    Null texts count as empty: one line, which stays. Rows that repeat doc_id and text are one document that is listed
    as often; null doc_ids come first; an empty table gives no row.
    """
    docs = _shared.table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    counted = _keyed(docs).select("doc_id", "row", F.size(F.split("text", "\n")).cast("bigint").alias("n_lines"))
    dropped = dropped_lines(docs).select(F.col("doc_id").alias("d"), F.col("row").alias("r"), "dropped")
    out = counted.join(dropped, counted["doc_id"].eqNullSafe(F.col("d")) & (F.col("row") == F.col("r")), "left")
    gone = F.coalesce("dropped", F.array().cast("array<int>"))
    return out.select("doc_id", "n_lines", F.size(gone).cast("bigint").alias("n_dropped"), gone.alias("dropped"))
