"""Removal of repeated multi-line passages by content-defined chunks of lines.

A text is cut into lines and each line hashed. A hash rolls over each two neighbouring lines, and chooses bounds at several
scales: at scale r a line is a bound if the hash that begins there is the least within r lines on both sides, so bounds
depend on the lines around them alone and shift with them. A chunk reaches from one bound to the next, the two lines of either included; at the finest
scale (0) every line is a bound, and a chunk is a pair of lines. Chunks of LEAST words or more are looked up in the whole
corpus. A chunk that occurs twice is a seed, which is extended on both sides line by line, while the two lines of the
window occur elsewhere too. So short pairs of lines ("Yes.", "No.") that texts share by chance stay, but those at the edge of a passage
go with it. A line of over LONG words is a passage alone. Blank lines count for nothing, and go with the lines around them.
Lines are removed after a comparison of their bytes. All steps are built-in expressions.

What is found: any repeated passage with two neighbouring lines of LEAST words, thus any of over 50 words in at most 12 lines;
of longer ones of nothing but very short lines those that hold a chunk of a coarser scale. Drawn at random, 4 in 1,000 of 13 lines
of four words hold none, 12 in 1,000 of 51 lines of one word, none of 20,000 with 17 lines of three words or 26 of two. Equal lines in a row hold no bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.shared import cut, stored

#: Words over which a line is a passage of its own.
LONG = 50
#: The least words of a chunk of several lines.
LEAST = 9
#: The scales above the finest: how many lines away on both sides no lesser hash begins.
SCALES = (1, 3)
#: What the rolling hash multiplies by, its modulus, and what stands for no hash; fixed, as bounds follow from them.
FACTOR, MODULUS, NONE = 1_000_003, 2_147_483_647, 2_147_483_648


def line_hash(line: Column) -> Column:
    return F.xxhash64(line)


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is computed once: without a generator between, every use of it, also within
    lambdas, would compute it again."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def body_of(text: str) -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def n_words(line: Column) -> Column:
    """Runs of characters other than blanks and tabs in a line that has any."""
    return F.size(F.split(F.trim(F.regexp_replace(line, "[ \\t]+", " ")), " ", -1))


def light_hash(line: Column) -> Column:
    """28 bits of a line, from which the rolling hash is made."""
    return F.conv(F.substring(F.md5(line), 1, 7), 16, 10).cast("long")


def is_blank(line: Column) -> Column:
    return F.trim(line, F.lit(" \t\r")) == ""


def chunks(docs: DataFrame, long: int = LONG, least: int = LEAST, text: str = "text") -> DataFrame:
    """``doc_id, row, number, upto, a, b, seed, window``: the windows and chunks of all texts by the numbers (from 1) of their first and last lines.

    A window is each two lines between which there are but blank ones (``a, b`` their hashes), or a line of over ``long`` words (``b`` null). It is a
    ``seed`` alone if it has ``least`` words: a chunk of the finest scale. Chunks of the other scales (``a`` the hash
    of all their lines', ``b`` their number and scale; not ``window``) are given where no two neighbouring lines of theirs have ``least`` words, for
    all others hold a seed. ``row`` names a row by id and text, and is the same for repeated rows."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body_of(text).alias("text"))
    line = F.transform(lines_of(F.col("text")), lambda x: F.struct(x.alias("x"), F.when(~is_blank(x), n_words(x)).alias("w")))
    line = F.transform(line, lambda x, i: F.struct(i.alias("i"), line_hash(x["x"]).alias("h"), x["w"].alias("w"), F.when(x["w"] < least, light_hash(x["x"])).alias("q")))
    base = base.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), F.filter(line, lambda x: x["w"].isNotNull()).alias("l"))
    base = once(base, "m", F.col("l")).drop("l")

    def rolling(x: Column, k: Column) -> Column:
        after = F.get("m", k + 1)
        return F.coalesce(F.when((x["w"] + after["w"] < least), (x["q"] * FACTOR + after["q"]) % MODULUS), F.lit(NONE))

    base = once(base, "r", F.transform("m", rolling))
    pair = F.transform("m", lambda x, k: F.struct((x["i"] + 1).alias("number"), (F.get("m", k + 1)["i"] + 1).alias("upto"), x["h"].alias("a"), F.get("m", k + 1)["h"].alias("b"), (F.get("r", k) == NONE).alias("seed"), F.lit(True).alias("window")))
    alone = F.transform(F.filter("m", lambda x: x["w"] > long), lambda x: F.struct((x["i"] + 1).alias("number"), (x["i"] + 1).alias("upto"), x["h"].alias("a"), F.lit(None).cast("long").alias("b"), F.lit(True).alias("seed"), F.lit(True).alias("window")))
    every = [F.filter(pair, lambda x: x["upto"].isNotNull()), alone]
    for scale in SCALES:
        base = once(base, f"at{scale}", _bounds(scale))
        every.append(_chunks(scale, least))
    return base.select("doc_id", "row", F.explode(F.concat(*every)).alias("c")).select("doc_id", "row", "c.*")


def _bounds(scale: int) -> Column:
    """Where in ``r`` a rolling hash is less than those before it and not above those after it, as far as ``scale``."""

    def at(v: Column, k: Column) -> Column:
        out = v < NONE
        for d in range(1, scale + 1):
            out = out & (v < F.coalesce(F.get("r", k - d), F.lit(NONE))) & (v <= F.coalesce(F.get("r", k + d), F.lit(NONE)))
        return F.when(out, k)

    return F.array_compact(F.transform("r", at))


def _chunks(scale: int, least: int) -> Column:
    """The chunks from each bound in ``at<scale>`` to the next, without those in which two neighbouring lines have ``least`` words, or all
    together fewer."""

    def chunk(k: Column, j: Column) -> Column:
        then = F.get(f"at{scale}", j + 1)
        # by place: a slice would read the whole array for each chunk
        light = F.forall(F.sequence(k, then), lambda t: F.get("r", t) < NONE)
        lines = F.transform(F.sequence(k, then + 1), lambda t: F.get("m", t))
        words = F.aggregate(lines, F.lit(0), lambda n, x: n + x["w"])
        found = F.struct((F.get("m", k)["i"] + 1).alias("number"), (F.get("m", then + 1)["i"] + 1).alias("upto"), F.xxhash64(F.transform(lines, lambda x: x["h"])).alias("a"), (F.size(lines) * 16 + scale).cast("long").alias("b"), F.lit(True).alias("seed"), F.lit(False).alias("window"))
        return F.when(then.isNotNull() & light, F.when(words >= least, found))

    return F.array_compact(F.transform(f"at{scale}", chunk))


def _passages(hits: DataFrame) -> DataFrame:
    """The windows of ``hits`` that a seed reaches through windows that overlap."""
    # repeated rows have the same windows: combined before a text's windows meet
    each = hits.groupBy("row", "doc_id", "number", "upto").agg(F.max("seed").alias("seed"), F.max("window").alias("window"), F.max("is_first").alias("is_first"))
    order = Window.partitionBy("row", "doc_id").orderBy("number", "upto")
    runs = each.withColumn("before", F.max("upto").over(order.rowsBetween(Window.unboundedPreceding, -1))).withColumn("run", F.sum(F.when(F.col("number") <= F.col("before"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.withColumn("seeded", F.max("seed").over(Window.partitionBy("row", "doc_id", "run"))).where("seeded AND window")


def _marked(source: DataFrame, hits: DataFrame, text: str) -> DataFrame:
    """``source`` with ``_ld_old`` and ``_ld_new``: the numbers of lines in windows that occurred before, and in windows that
    occur first here and again elsewhere."""
    per = _passages(hits).select("row", "doc_id", "is_first", F.explode(F.sequence("number", "upto")).alias("line")).groupBy("row", "doc_id").agg(F.collect_set(F.when(~F.col("is_first"), F.col("line"))).alias("_ld_old"), F.collect_set(F.when(F.col("is_first"), F.col("line"))).alias("_ld_new"))
    # materialised, so that both sides of the join come from plain shuffles and a row that is repeated very often can be split
    per = cut(per.select(F.col("row").alias("_ld_row"), F.col("doc_id").alias("_ld_id"), "_ld_old", "_ld_new"))
    keyed = source.withColumn("_ld_key", F.xxhash64(F.col("doc_id").cast("long"), body_of(text)))
    return keyed.join(per, (F.col("_ld_key") == F.col("_ld_row")) & F.col("doc_id").cast("long").eqNullSafe(F.col("_ld_id")), "left").drop("_ld_row", "_ld_id", "_ld_key")


def dedup_lines(docs: DataFrame, long: int = LONG, least: int = LEAST, text: str = "text") -> DataFrame:
    """The documents with ``text`` less its repeated multi-line passages, and ``n_removed`` lines.

    Chunks and windows are counted over all documents, combined on the map side; windows that repeat and that a repeated chunk
    of ``least`` words reaches (or a line of over ``long`` words) are passages. With ``least`` 0 every repeated window is. The
    first occurrence of a window (smallest doc_id, then row, then place; null ids last) stays whole; a line goes if a
    passage's window over it occurred before and none over it is such a first occurrence. So every passage
    that is repeated anywhere remains once in one piece. Lines are compared by their bytes: a hash that stands for different lines
    removes nothing. Texts are shuffled once and stored once.

    All other columns stay as they are, whatever their names but ``n_removed``. Null texts stay null,
    empty ones empty. Rows with equal id and text count as one document: they don't remove each
    other's chunks. An empty table gives an empty result.
    """
    source = docs.drop("n_removed")
    found = cut(chunks(source, long, least, text))
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "number")
    # the tables of hashes are materialised, so that both sides of the joins on them come from plain shuffles and a very
    # common window can be split over tasks
    counts = cut(found.groupBy("a", "b").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").select(F.col("a").alias("x"), F.col("b").alias("y"), "first"))
    hits = found.join(counts, (F.col("a") == F.col("x")) & F.col("b").eqNullSafe(F.col("y"))).select("row", "doc_id", "number", "upto", "a", "b", "seed", "window", (place == F.col("first")).alias("is_first"))
    marked = stored(_marked(source, hits, text), "marked")
    # the bytes of all lines in repeated windows: a hash of two different lines is told apart here
    repeated = once(marked.where("_ld_old IS NOT NULL").select("_ld_old", "_ld_new", body_of(text).alias("t")), "l", lines_of(F.col("t")))
    seen = repeated.select(F.explode(F.transform(F.array_union("_ld_old", "_ld_new"), lambda i: F.get("l", i - 1))).alias("line"))
    mixed = cut(seen.distinct().select(line_hash(F.col("line")).alias("h")).groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
    if not mixed.isEmpty():
        hits = hits.join(mixed, F.col("a") == F.col("h"), "left_anti").join(mixed, F.col("b").eqNullSafe(F.col("h")), "left_anti")
        marked = stored(_marked(source, hits, text), "marked")
    gone = once(marked.where("_ld_old IS NOT NULL"), "_ld_gone", F.sort_array(F.array_except("_ld_old", "_ld_new")))
    lines = once(gone, "_ld_lines", lines_of(body_of(text)))
    bounds = once(lines, "_ld_at", F.concat(F.array(F.lit(0)), F.col("_ld_gone"), F.array(F.size("_ld_lines") + 1)))

    def between(k: Column) -> Column:
        first, last = F.get("_ld_at", k - 1), F.get("_ld_at", k) - 2
        return F.when(first <= last, F.transform(F.sequence(first, last), lambda t: F.get("_ld_lines", t))).otherwise(F.array().cast("array<string>"))

    # what lies between lines that go, by place: linear in the lines
    kept = F.transform(F.sequence(F.lit(1), F.size("_ld_at") - 1), between)
    some = bounds.withColumn("n_removed", F.size("_ld_gone")).withColumn(text, F.when(F.col("n_removed") == 0, F.col(text)).otherwise(F.array_join(F.flatten(kept), "\n")))
    whole = marked.where("_ld_old IS NULL").withColumn("n_removed", F.lit(0))
    return whole.select(*source.columns, "n_removed").unionByName(some.select(*source.columns, "n_removed"))


def _bound(scale: int) -> str:
    sides = [f"v < coalesce(lag(v, {d}) OVER d, {NONE}) AND v <= coalesce(lead(v, {d}) OVER d, {NONE})" for d in range(1, scale + 1)]
    return " AND ".join([f"v < {NONE}", *sides])


ORACLE = rf"""
WITH l AS (SELECT doc_id, i, line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents) t, unnest(ls) WITH ORDINALITY u(line, i)),
m AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k, len(regexp_extract_all(line, '[^ \t]+')) AS w,
             CAST('0x' || substr(md5(line), 1, 7) AS BIGINT) AS q
      FROM l WHERE trim(line, ' ' || chr(9) || chr(13)) <> ''),
p AS (SELECT *, lead(i) OVER d AS upto, lead(line) OVER d AS b,
             CASE WHEN w + lead(w) OVER d < {LEAST} THEN (q * {FACTOR} + lead(q) OVER d) % {MODULUS} ELSE {NONE} END AS v
      FROM m WINDOW d AS (PARTITION BY doc_id ORDER BY k)),
s AS (SELECT doc_id, k, sum(CAST(v = {NONE} AS INTEGER)) OVER d AS heavy, {", ".join(f"{_bound(x)} AS at{x}" for x in SCALES)}
      FROM p WINDOW d AS (PARTITION BY doc_id ORDER BY k)),
c AS (SELECT * FROM ({" UNION ALL ".join(f"SELECT {x} AS scale, doc_id, k, lead(k) OVER e AS k2, heavy, lead(heavy) OVER e AS heavy2 FROM s WHERE at{x} WINDOW e AS (PARTITION BY doc_id ORDER BY k)" for x in SCALES)}) t WHERE heavy = heavy2),
x AS (SELECT c.scale, c.doc_id, min(m.i) AS i, max(m.i) AS upto, string_agg(m.line, chr(10) ORDER BY m.k) AS a, CAST(NULL AS VARCHAR) AS b, true AS seed, false AS is_window
      FROM c JOIN m ON m.doc_id = c.doc_id AND m.k BETWEEN c.k AND c.k2 + 1 GROUP BY c.scale, c.doc_id, c.k HAVING sum(m.w) >= {LEAST}),
w AS (SELECT 0 AS scale, doc_id, i, upto, line AS a, b, v = {NONE} AS seed, true AS is_window FROM p WHERE upto IS NOT NULL
      UNION ALL SELECT 0, doc_id, i, i, line, NULL, true, true FROM p WHERE w > {LONG} UNION ALL FROM x),
f AS (SELECT *, count(*) OVER p > 1 AS again, row_number() OVER (p ORDER BY doc_id, i) = 1 AS is_first FROM w WINDOW p AS (PARTITION BY scale, a, b)),
h AS (SELECT *, max(upto) OVER (PARTITION BY doc_id ORDER BY i, upto, is_window ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM f WHERE again),
r AS (SELECT *, sum(CASE WHEN i <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i, upto, is_window ROWS UNBOUNDED PRECEDING) AS run FROM h),
o AS (SELECT *, bool_or(seed) OVER (PARTITION BY doc_id, run) AS seeded FROM r),
e AS (SELECT doc_id, i + unnest(range(upto - i + 1)) AS i, is_first FROM o WHERE seeded AND is_window),
g AS (SELECT doc_id, i, NOT bool_or(is_first) AS gone FROM e GROUP BY doc_id, i)
SELECT l.doc_id, coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (NOT coalesce(gone, false)), '') AS text,
       CAST(count(*) FILTER (coalesce(gone, false)) AS INTEGER) AS n_removed
FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id
"""
