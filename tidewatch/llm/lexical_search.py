"""Ranked lexical search over an inverted index in shards, by the Best Position Algorithm.

The index is a table with a row per (shard, term): the shard's documents that hold the term, and how often. A shard is a
few megabytes of text that one task read, so a very common term has a bounded list in each of many shards, and an index grows by
appending shards. A search orders the lists of its terms by impact within each shard, finds the shard's best documents, and ranks those of all
shards together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.shared import stored

#: Characters of text a shard holds (a longer text is alone), and rows of query terms that are searched for together.
SHARD_CHARS, TOGETHER = 8_000_000, 200_000
#: Places of a list read in the first round; each round reads twice as many.
FIRST = 32
#: Bytes that don't belong to terms become blanks, A to Z become lower case; bytes of other characters stay.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
INDEX = "shard long, term string, places array<int>, counts array<int>, ids array<long>"


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in order: letters and digits of ASCII and all characters beyond it, only A to Z lower-cased."""
    return text.encode().translate(_TABLE).split() if text else []


def shard_batch(shard: int, ids: list[int | None], texts: list[str | None]) -> pa.RecordBatch:
    """A shard's rows: one per term, and one of no term with the documents' ids and numbers of terms."""
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))  # places in the order of ids: equal scores rank by place
    ids = [ids[i] for i in order]
    numbers: dict[bytes, int] = {}
    found = [np.fromiter((numbers.setdefault(t, len(numbers)) for t in terms(texts[i])), np.int64) for i in order]
    n = np.fromiter(map(len, found), np.int64, len(found))
    key, counts = np.unique(np.concatenate(found) * len(ids) + np.repeat(np.arange(len(ids)), n), return_counts=True)
    ends = np.cumsum(np.bincount(key // len(ids), minlength=len(numbers)))
    offsets = pa.array(np.concatenate([[0], ends, [len(key) + len(ids)]]).astype(np.int32))
    places = pa.array(np.concatenate([key % len(ids), np.arange(len(ids))]).astype(np.int32))
    held = pa.array([*[None] * len(numbers), ids], pa.list_(pa.int64()))
    names = pa.array([*(t.decode() for t in numbers), None], pa.string())
    columns = [pa.array(np.full(len(names), shard)), names, pa.ListArray.from_arrays(offsets, places), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([counts, n]).astype(np.int32))), held]
    return pa.RecordBatch.from_arrays(columns, ["shard", "term", "places", "counts", "ids"])


def build_index(docs: DataFrame, path: str, shard_chars: int = SHARD_CHARS) -> None:
    """Write the index of ``docs(doc_id, text)`` below ``path``, in one narrow pass.

    A null text has no terms; rows with equal or null ids are documents of their own. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made, ids, texts, size = TaskContext.get().partitionId() << 32, 0, [], [], 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if size and size + len(text or "") > shard_chars:
                    yield shard_batch(first + made, ids, texts)
                    made, ids, texts, size = made + 1, [], [], 0
                ids.append(i)
                texts.append(text)
                size += len(text or "")
        if ids:
            yield shard_batch(first + made, ids, texts)

    docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, INDEX).write.option("compression", "zstd").parquet(path)


def best_positions(lists: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray, place_of, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The k documents of the highest sum of weighted impacts, by the Best Position Algorithm, and their sums; and the number of sorted accesses.

    ``lists`` are (documents, impacts), highest impact first. ``place_of(documents)`` is the direct access: for each list and document the place in the list (-1: none) and the
    impact. A list's best position is the last up to which every place was seen, by either access. No document not seen yet scores more than the
    weighted impacts at the best positions together; once that is strictly below the kth score, the k are found.
    """
    lens = np.array([len(d) for d, _ in lists])
    seen = [np.zeros(n + 1, bool) for n in lens]  # the last stays False
    best = np.zeros(len(lists), np.int64)
    known: set[int] = set()
    docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    depth, step, read = 0, FIRST, 0
    while depth < lens.max():
        met = np.unique(np.concatenate([d[depth : depth + step] for d, _ in lists]))
        read += int(np.clip(lens - depth, 0, step).sum())
        depth += step
        new = met[[d not in known for d in met.tolist()]] if known else met
        if len(new):
            known.update(new.tolist())
            place, impact = place_of(new)
            for s, p in zip(seen, place):
                s[p[p >= 0]] = True
            docs, scores = np.concatenate([docs, new]), np.concatenate([scores, weights @ impact])
        bound = 0
        for i, (s, (_, impact)) in enumerate(zip(seen, lists)):
            best[i] += int(s[best[i] :].argmin())
            if best[i] < lens[i]:  # a list seen whole has nothing for other documents
                bound += int(weights[i]) * int(impact[max(best[i] - 1, 0)])
        if len(docs) >= k and bound < np.partition(scores, len(scores) - k)[-k]:
            break
        step *= 2
    top = np.lexsort((docs, -scores))[:k]
    return docs[top], scores[top], read


class Shard:
    """One shard's lists of some terms, by impact and by document."""

    def __init__(self, term: np.ndarray, places: list, counts: list, n: np.ndarray, norm: tuple[int, int]):
        self.term, self.size = term, max(len(n), 1)
        self.lens = np.array([len(p) for p in places], np.int64)
        self.at = np.cumsum(self.lens) - self.lens
        place, tf = (np.concatenate(x).astype(np.int64) if len(x) else np.zeros(0, np.int64) for x in (places, counts))
        own = np.repeat(np.arange(len(term)), self.lens)
        total, length = norm
        m = 25 + 75 * n.astype(np.int64) * total // max(length, 1)
        self.impact = 1_000_000_000 * tf // (1000 * tf + 8 * m[place])
        self.key = own * self.size + place  # ascending: terms in order, places within
        order = np.lexsort((place, -self.impact, own))
        self.by_doc, self.by_impact = place[order], self.impact[order]
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.arange(len(order)) - self.at[own[order]]

    def search(self, which: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k best documents for the lists numbered ``which``."""

        def place_of(docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            wanted = which[:, None] * self.size + docs[None, :]
            i = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
            there = self.key[i] == wanted
            return np.where(there, self.rank[i], -1), np.where(there, self.impact[i], 0)

        lists = [(self.by_doc[a : a + n], self.by_impact[a : a + n]) for a, n in zip(self.at[which].tolist(), self.lens[which].tolist())]
        docs, scores, _ = best_positions(lists, weights, place_of, k)
        return docs[scores > 0], scores[scores > 0]


def query_terms(queries: DataFrame) -> DataFrame:
    """``query, item_id, term, times``: the terms of every row of ``queries(item_id, text)``; ``query`` numbers the rows."""

    @F.pandas_udf("array<string>")
    def split(s: pd.Series) -> pd.Series:
        return pd.Series([[t.decode() for t in terms(x)] for x in s], dtype=object)

    rows = queries.select(F.monotonically_increasing_id().alias("query"), F.col("item_id"), split(F.col("text").cast("string")).alias("t"))
    return rows.select("query", "item_id", F.explode("t").alias("term")).groupBy("query", "item_id", "term").agg(F.count("*").alias("times"))


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = 10) -> DataFrame:
    """``item_id, rank, doc_id, score``: for every row of ``queries(item_id, text)`` its k highest-scoring documents of the index at ``path`` with a score above 0
    (all, if fewer), equal scores by ascending id (null last).

    Queries are taken in blocks of at most TOGETHER rows of terms and one more query, so what is sent to all tasks is bounded whatever their number;
    a block reads the lists of its own terms, which meet by shard. Each shard yields at most k documents a query, and ranking keeps k of each task's before the
    shuffle. Queries without terms, or without a document that has any, give no rows; rows with equal item ids are ranked each on their own.
    """
    index = spark.read.schema(INDEX).parquet(path)
    lengths = index.where("term IS NULL").select(F.explode("counts").alias("n"))
    total, length = lengths.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    asked = stored(query_terms(queries), "query-terms")
    df = index.join(asked.select("term").distinct(), "term").groupBy("term").agg(F.sum(F.size("places")).alias("df"))
    weight = F.floor(1000 * F.log((F.lit(2.0 * total + 2)) / (2 * F.col("df") + 1))).cast("long")
    asked = stored(asked.join(df.select("term", weight.alias("w")), "term").where("w > 0").select("query", "item_id", "term", (F.col("times") * F.col("w")).alias("weight")), "weighted-terms")
    sizes = asked.groupBy("query").agg(F.count("*").alias("n")).orderBy("query")
    best = None
    block: list[int] = []
    held = 0

    def blocks() -> Iterator[list[int]]:
        nonlocal block, held
        for row in sizes.toLocalIterator():
            block.append(row["query"])
            held += row["n"]
            if held >= TOGETHER:
                yield block
                block, held = [], 0
        if block:
            yield block

    for own in blocks():
        part = stored(searched(index, asked.where(F.col("query").between(own[0], own[-1])), (total, length), k), "shard-results")
        best = part if best is None else best.unionByName(part)
    if best is None:
        best = spark.createDataFrame([], "query long, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    best = best.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.join(asked.select("query", "item_id").distinct(), "query").select("item_id", "rank", "doc_id", "score")


def searched(index: DataFrame, asked: DataFrame, norm: tuple[int, int], k: int) -> DataFrame:
    """``query, doc_id, score``: the k best documents of every shard for a block of queries (``query, term, weight``)."""
    rows = asked.select("query", "term", "weight").collect()  # a block: bounded by TOGETHER and one query
    names = {t: i for i, t in enumerate(sorted({r["term"] for r in rows}))}
    queries: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for r in rows:
        queries.setdefault(r["query"], ([], []))  # type: ignore[arg-type]
        queries[r["query"]][0].append(names[r["term"]])
        queries[r["query"]][1].append(r["weight"])
    queries = {q: (np.array(t, np.int64), np.array(w, np.int64)) for q, (t, w) in queries.items()}
    numbers = index.sparkSession.createDataFrame(list(names.items()), "term string, number int")
    lists = index.join(F.broadcast(numbers), "term", "left").where("term IS NULL OR number IS NOT NULL").select("shard", "number", "places", "counts", "ids")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        head = pdf[pdf["number"].isna()].iloc[0]
        body = pdf[pdf["number"].notna()]
        ids = [None if pd.isna(i) else int(i) for i in head["ids"]]
        term = body["number"].to_numpy(np.int64)
        shard = Shard(term, list(body["places"]), list(body["counts"]), np.asarray(head["counts"]), norm)
        local = np.full(len(names), -1, np.int64)
        local[term] = np.arange(len(term))
        out: list[tuple] = []
        for q, (which, weights) in queries.items():
            there = local[which] >= 0
            if there.any():
                docs, scores = shard.search(local[which[there]], weights[there], k)
                out += [(q, ids[d], s) for d, s in zip(docs.tolist(), scores.tolist())]
        made = pd.DataFrame(out, columns=["query", "doc_id", "score"])
        return made.assign(doc_id=pd.array(made["doc_id"].tolist(), "Int64"))

    return lists.groupBy("shard").applyInPandas(run, "query long, doc_id long, score long")


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
g AS (SELECT count(*) AS nn, sum(len(ts)) AS ll FROM d WHERE len(ts) > 0),
tf AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(ts) AS t FROM d) GROUP BY ALL),
df AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(nn) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, g GROUP BY t),
dm AS (SELECT doc_id, 25 + CAST(75 * len(ts) * nn AS BIGINT) // CAST(ll AS BIGINT) AS m FROM d, g),
q AS (SELECT item_id, t, count(*) AS c FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark) GROUP BY ALL),
s AS (SELECT item_id, tf.doc_id, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM q JOIN df ON df.t = q.t JOIN tf ON tf.t = q.t JOIN dm ON dm.doc_id = tf.doc_id GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS k FROM s WHERE score > 0)
SELECT item_id, CAST(k AS INTEGER) AS rank, doc_id, score FROM r WHERE k <= 10
"""
