"""Quotation linking for chat messages, with DataFrame functions alone.

Lines that begin with ``>`` marks are quotes, as deep as they have marks. Runs of quoted lines of one
level are passages; a passage is normalised and hashed and joined to the messages of its conversation
whose own words hold it, as a whole, as some of their lines or as part of a line, however it was wrapped, which
gives reply links. Messages are returned without their quotes, with the place they take in reply order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.shared import cut

MARKS = r"^(?:[ \t]*>)+"
#: A line of its own words right before a quote that says whose it is; it goes with the quote.
ATTRIBUTION = r"(?i)\b(?:wrote|writes|said)[ \t]*:[ \t\r]*$"
#: Words up to which a passage is looked up whole; a longer one is looked up by as many first words and then compared whole.
ANCHOR = 8
#: Passages of fewer words must be a whole line or a whole message.
FEW = 3


def quote_level(line: Column) -> Column:
    """How many ``>`` marks a line begins with, blanks between them allowed."""
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 0), "[^>]", ""))


def normalised(text: Column) -> Column:
    """Lower case, runs of white space as one blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def parse_quotes(messages: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """A row per line: the key columns, ``line_no``, ``level`` (0: own words), ``line`` without its marks."""
    lines = messages.select(*key, F.posexplode(F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), "\n", -1)).alias("line_no", "raw"))
    return lines.select(*key, "line_no", quote_level(F.col("raw")).alias("level"), F.regexp_replace("raw", MARKS + " ?", "").alias("line"))


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is computed once, a generator of one row standing between it and its uses."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _with_runs(rows: DataFrame) -> DataFrame:
    """Adds ``runs``: the runs of neighbouring lines of one level, ``level, body``; lines that say whose words follow are
    level -1. Every step is linear in the lines."""
    df = _once(rows, "_l", F.transform(F.split("text", "\n", -1), lambda x: F.struct(quote_level(x).alias("level"), F.regexp_replace(x, MARKS + " ?", "").alias("body"))))
    named = lambda x, i: (x["level"] == 0) & (F.coalesce(F.get("_l", i + 1)["level"], F.lit(0)) > 0) & x["body"].rlike(ATTRIBUTION)
    df = _once(df, "_m", F.transform("_l", lambda x, i: F.struct(F.when(named(x, i), -1).otherwise(x["level"]).alias("level"), x["body"].alias("body"))))
    begins = F.filter(F.sequence(F.lit(0), F.size("_m") - 1), lambda i: (i == 0) | (F.get("_m", i)["level"] != F.get("_m", F.greatest(i - 1, F.lit(0)))["level"]))
    df = _once(df, "_b", F.concat(begins, F.array(F.size("_m"))))
    run = lambda k: F.struct(F.get("_m", F.get("_b", k))["level"].alias("level"), F.array_join(F.transform(F.slice("_m", F.get("_b", k) + 1, F.get("_b", k + 1) - F.get("_b", k)), lambda x: x["body"]), "\n").alias("body"))
    return _once(df, "runs", F.transform(F.sequence(F.lit(0), F.size("_b") - 2), run)).select(*rows.columns, "runs")


def _passages(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, no, level, n, hash, anchor``: each quoted passage with its words counted and hashed, whole and the
    first ANCHOR of them."""
    quotes = rows.where("conv_id IS NOT NULL AND turn IS NOT NULL AND exists(runs, r -> r.level > 0)")
    quotes = quotes.select("conv_id", "turn", F.posexplode(F.filter("runs", lambda r: r["level"] > 0)).alias("no", "r"))
    quotes = quotes.select("conv_id", "turn", "no", F.col("r.level").alias("level"), normalised(F.col("r.body")).alias("passage")).where("passage <> ''")
    quotes = quotes.select("conv_id", "turn", "no", "level", "passage", F.split("passage", " ", -1).alias("w"))
    return quotes.select("conv_id", "turn", "no", "level", F.size("w").alias("n"), F.sha2("passage", 256).alias("hash"), F.sha2(F.array_join(F.slice("w", 1, ANCHOR), " "), 256).alias("anchor")).distinct()


def _held(rows: DataFrame, quotes: DataFrame) -> DataFrame:
    """``conv_id, hash, said_at``: the passages that the own words of each turn hold.

    Different passages of a conversation are looked up, not their occurrences: passages of up to ANCHOR words
    by their hash among the runs of as many words of what was said (only of lengths that the conversation's
    quotes have), longer ones by their first ANCHOR words, after which all their words are compared.
    """
    wanted = cut(quotes.select("conv_id", "n", "hash", "anchor").distinct())
    lengths = wanted.groupBy("conv_id").agg(F.collect_set(F.least("n", F.lit(ANCHOR))).alias("lengths"))
    own = rows.where("turn IS NOT NULL").join(lengths, "conv_id")
    own = own.select("conv_id", "turn", "lengths", F.array_join(F.transform(F.filter("runs", lambda r: r["level"] == 0), lambda r: r["body"]), "\n").alias("own"))
    # equal messages of a conversation are looked up once
    own = own.groupBy("conv_id", "own", "lengths").agg(F.collect_set("turn").alias("turns")).where(normalised(F.col("own")) != "")
    own = cut(own.select("conv_id", "turns", "lengths", "own", F.split(normalised(F.col("own")), " ", -1).alias("w"), F.xxhash64("own").alias("text_id")))
    runs = own.select("conv_id", "text_id", "w", F.explode(F.filter("lengths", lambda n: (n >= FEW) & (n <= F.size("w")))).alias("k"))
    at = F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("k") + 1), lambda i: F.struct(i.alias("i"), F.sha2(F.array_join(F.slice("w", i, F.col("k")), " "), 256).alias("h"))))
    found = runs.select("conv_id", "text_id", "k", at.alias("x")).select("conv_id", "text_id", "k", "x.i", F.col("x.h").alias("anchor"))
    short = found.where(F.col("k") < ANCHOR).join(wanted.where(F.col("n") < ANCHOR).select("conv_id", "hash", F.col("hash").alias("anchor")), ["conv_id", "anchor"]).select("conv_id", "text_id", "hash").distinct()
    begun = found.where(F.col("k") == ANCHOR).join(wanted.where(F.col("n") >= ANCHOR), ["conv_id", "anchor"]).select("conv_id", "text_id", "i", "n", "hash")
    whole = begun.join(own.select("conv_id", "text_id", "w"), ["conv_id", "text_id"]).where((F.col("i") + F.col("n") - 1 <= F.size("w")) & (F.sha2(F.array_join(F.slice("w", F.col("i"), F.col("n")), " "), 256) == F.col("hash")))
    parts_ = F.array_distinct(F.transform(F.concat(F.array("own"), F.split("own", "\n", -1)), lambda x: F.sha2(normalised(x), 256)))
    few = own.where(F.exists("lengths", lambda n: n < FEW)).select("conv_id", "text_id", F.explode(parts_).alias("hash")).join(wanted.where(F.col("n") < FEW).select("conv_id", "hash"), ["conv_id", "hash"])
    held = short.unionByName(whole.select("conv_id", "text_id", "hash")).unionByName(few.select("conv_id", "text_id", "hash")).distinct()
    return held.join(own.select("conv_id", "text_id", F.explode("turns").alias("said_at")), ["conv_id", "text_id"]).select("conv_id", "hash", "said_at")


def link_quotes(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, role, clean_text, quote_depth, n_quotes, n_linked, reply_to, root_turn, depth``.

    ``reply_to`` is the latest earlier turn of the conversation whose own words hold the message's first
    level-1 passage that any earlier turn said: its words, normalised, one after another (compared by a 256-bit hash), so a
    passage may be several lines, part of a paragraph or of a line, and wrapped anew; one of fewer than FEW
    words must be a whole line or message. Null if there is none. ``root_turn`` and ``depth`` follow
    the links: ordering a conversation by (root_turn, depth, turn) puts each reply after what it
    answers. Deeper levels count in ``quote_depth`` and ``n_quotes`` and link through ``n_linked``. A line
    like "On Monday u wrote:" right before a quote goes with it.

    Null texts are empty. Rows without conv_id or turn keep their row and link to nothing. Repeated
    (conv_id, turn) rows each keep a row; links are to the turn. Passages meet what was said before by a window over both
    together, by (conversation, passage), so a phrase quoted and said very often makes no pairs. An empty table gives an
    empty result. Other columns are ignored.
    """
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), body.alias("text"))
    quoted = F.col("text").rlike(r"(?m)" + MARKS)
    plain = base.where(~quoted).select("conv_id", "turn", "role", F.explode(F.array(F.array(F.struct(F.lit(0).alias("level"), F.col("text").alias("body"))))).alias("runs"))
    rows = plain.unionByName(_with_runs(base.where(quoted)).select("conv_id", "turn", "role", "runs"))

    quotes = cut(_passages(rows))
    if quotes.isEmpty():
        at = per = rows.select("conv_id", "turn", F.lit(0).cast("long").alias("n_linked"), F.lit(None).cast("long").alias("reply_to"), F.lit(None).cast("long").alias("up"), F.lit(None).cast("int").alias("depth")).where("false")
    else:
        # the last turn before a quote at which its passage was said: as of the turn, in one pass over both
        asked = quotes.select("conv_id", "hash", "turn", F.lit(1).alias("kind"), "no", "level", F.lit(None).cast("long").alias("said_at"))
        said = _held(rows, quotes).select("conv_id", "hash", F.col("said_at").alias("turn"), F.lit(2).alias("kind"), F.lit(None).cast("int").alias("no"), F.lit(None).cast("int").alias("level"), "said_at")
        earlier = Window.partitionBy("conv_id", "hash").orderBy("turn", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        hit = asked.unionByName(said).withColumn("said_at", F.last("said_at", ignorenulls=True).over(earlier)).where("kind = 1 AND said_at IS NOT NULL")
        per = hit.groupBy("conv_id", "turn").agg(F.count("*").alias("n_linked"), F.min(F.when(F.col("level") == 1, F.struct("no", "said_at"))).alias("first"))
        per = cut(per.select("conv_id", "turn", "n_linked", F.col("first.said_at").alias("reply_to")))
        # pointer doubling: after k rounds a link spans 2^k replies
        at = per.where("reply_to IS NOT NULL").select("conv_id", "turn", F.col("reply_to").alias("up"), F.lit(1).alias("depth"))
        while True:
            above = at.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("further"), F.col("depth").alias("more"))
            step = cut(at.join(above, ["conv_id", "up"], "left"))
            if step.where("further IS NOT NULL").isEmpty():
                break
            at = step.select("conv_id", "turn", F.coalesce("further", "up").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
        per = per.join(at, ["conv_id", "turn"], "left")

    level = lambda f: F.transform("runs", f)
    shown = rows.select(
        "conv_id", "turn", "role",
        F.trim(F.array_join(F.transform(F.filter("runs", lambda r: r["level"] == 0), lambda r: r["body"]), "\n"), F.lit(" \t\r\n")).alias("clean_text"),
        F.greatest(F.array_max(level(lambda r: r["level"])), F.lit(0)).alias("quote_depth"),
        F.size(F.filter("runs", lambda r: r["level"] > 0)).alias("n_quotes"),
    )
    out = shown.join(per, ["conv_id", "turn"], "left")
    return out.select("conv_id", "turn", "role", "clean_text", "quote_depth", "n_quotes", F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), "reply_to", F.coalesce("up", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0)).alias("depth"))


def chat_format(linked: DataFrame, open_mark: str = "<|", close_mark: str = "|>") -> DataFrame:
    """Adds ``formatted``: the role between marks, a line end and the words without quotes."""
    return linked.withColumn("formatted", F.concat(F.lit(open_mark), F.coalesce("role", F.lit("user")), F.lit(close_mark + "\n"), F.col("clean_text")))


ORACLE = r"""
WITH RECURSIVE b AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
l AS (SELECT conv_id, turn, role, i, raw FROM (SELECT conv_id, turn, role, string_split(text, chr(10)) AS ls FROM b) t, unnest(ls) WITH ORDINALITY u(raw, i)),
v AS (SELECT conv_id, turn, role, i, CAST(length(regexp_replace(regexp_extract(raw, '^(?:[ \t]*>)+'), '[^>]', '', 'g')) AS INTEGER) AS level,
        regexp_replace(raw, '^(?:[ \t]*>)+ ?', '') AS line FROM l),
p AS (SELECT conv_id, turn, role, i, line, CASE WHEN level = 0 AND lead(level) OVER (PARTITION BY conv_id, turn ORDER BY i) > 0
        AND regexp_matches(line, '(?i)\b(?:wrote|writes|said)[ \t]*:[ \t\r]*$') THEN -1 ELSE level END AS level FROM v),
s AS (SELECT *, sum(CASE WHEN level IS DISTINCT FROM prev THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, turn ORDER BY i) AS run
      FROM (SELECT *, lag(level) OVER (PARTITION BY conv_id, turn ORDER BY i) AS prev FROM p)),
r AS (SELECT conv_id, turn, any_value(role) AS role, run, any_value(level) AS level, string_agg(line, chr(10) ORDER BY i) AS body FROM s GROUP BY conv_id, turn, run),
m AS (SELECT conv_id, turn, any_value(role) AS role, coalesce(string_agg(body, chr(10) ORDER BY run) FILTER (level = 0), '') AS own,
        greatest(max(level), 0) AS quote_depth, CAST(count(*) FILTER (level > 0) AS INTEGER) AS n_quotes FROM r GROUP BY conv_id, turn),
q AS (SELECT conv_id, turn, run, level, trim(regexp_replace(lower(body), '\s+', ' ', 'g')) AS passage FROM r WHERE level > 0),
d AS (SELECT conv_id, turn, trim(regexp_replace(lower(own), '\s+', ' ', 'g')) AS own,
        list_transform(string_split(own, chr(10)), lambda x: trim(regexp_replace(lower(x), '\s+', ' ', 'g'))) AS lines FROM m),
h AS (SELECT q.conv_id, q.turn, q.run, q.level, max(d.turn) AS said_at FROM q JOIN d ON q.conv_id = d.conv_id AND d.turn < q.turn
        AND CASE WHEN len(string_split(passage, ' ')) < 3 THEN own = passage OR list_contains(lines, passage)
                 ELSE contains(' ' || own || ' ', ' ' || passage || ' ') END
      WHERE q.passage <> '' GROUP BY ALL),
k AS (SELECT conv_id, turn, count(*) AS n_linked, arg_min(said_at, run) FILTER (level = 1) AS reply_to FROM h GROUP BY conv_id, turn),
w AS (SELECT conv_id, turn, turn AS up, 0 AS depth FROM m UNION ALL
      SELECT w.conv_id, w.turn, k.reply_to, w.depth + 1 FROM w JOIN k ON w.conv_id = k.conv_id AND w.up = k.turn WHERE k.reply_to IS NOT NULL),
o AS (SELECT conv_id, turn, max(depth) AS depth, min(up) AS root_turn FROM w GROUP BY conv_id, turn)
SELECT m.conv_id, m.turn, m.role, trim(m.own, ' ' || chr(9) || chr(13) || chr(10)) AS clean_text, m.quote_depth, m.n_quotes,
       coalesce(k.n_linked, 0) AS n_linked, k.reply_to, o.root_turn, o.depth
FROM m LEFT JOIN k ON m.conv_id = k.conv_id AND m.turn = k.turn JOIN o ON m.conv_id = o.conv_id AND m.turn = o.turn
"""
