"""Lexical search, periodic runs and token counts against brute force, the library, and odd inputs."""

import hashlib
import random
import re
import time
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import lexical_search, periodic_runs, token_counts
from tidewatch.llm.queries import QUERIES, vocabulary
from tidewatch.llm.shared import new_folder

ODD = [(5, "a b c"), (5, "a b c"), (None, "a x"), (1, None), (2, ""), (3, " \n\t"), (4, "ÀÉ ß 漢字 🙂 <|endoftext|> don't"), (7, "word " * 5000), (6, "q_r-s A1"), (6, "other"), (None, "x y x y")]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    for name in ("term", "shard", "places", "counts", "ids", "query", "rank", "score", "n_tokens", "n_runs", "start", "length", "period", "number"):
        df = df.withColumn(name, F.lit("mine"))
    return df


# -- search


def scored(docs, query):
    """All documents' scores by the definition."""
    import math

    split = [lexical_search.terms(t) for _, t in docs]
    n, total = sum(1 for t in split if t), sum(map(len, split))
    out = []
    for (i, _), own in zip(docs, split):
        score = 0
        for t in lexical_search.terms(query):
            df, tf = sum(t in x for x in split), own.count(t)
            if tf:
                score += math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) * (1_000_000_000 * tf // (1000 * tf + 8 * (25 + 75 * len(own) * n // total)))
        out.append((i, score))
    return sorted((x for x in out if x[1] > 0), key=lambda x: (-x[1], x[0] is None, x[0] or 0))


def found(spark, docs, queries, k=10, **how):
    path = new_folder(spark, "index")
    lexical_search.build_index(docs, path, **how)
    out: dict = {}
    for r in lexical_search.search(spark, path, queries, k).orderBy("rank").collect():
        out.setdefault(r.item_id, []).append((r["rank"], r.doc_id, r.score))
    return out


def test_terms_are_ascii_letters_and_digits_and_all_beyond():

    rng = random.Random(1)
    for _ in range(500):
        text = "".join(rng.choice("aZ09 _-@[`{\x7f\x80\xa0é漢🙂İ\n\x00\x1c") for _ in range(30))
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        assert [t.decode() for t in lexical_search.terms(text)] == re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def test_search_equals_scoring_all(spark):
    rng = random.Random(2)
    words = [f"w{int(rng.paretovariate(0.7)) % 90}" for _ in range(400)]
    docs = [(rng.randrange(200), " ".join(rng.choices(words, k=rng.randint(0, 60)))) for _ in range(300)]
    docs += [(500 + i, "same text again") for i in range(30)]
    queries = [(i, " ".join(rng.choices(words, k=rng.randint(1, 9)))) for i in range(30)] + [(40, "again same"), (41, "nothing-of-this"), (42, None), (43, "w1 " * 50)]
    df, q = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(queries, "item_id long, text string")
    for chars in (400, 10**9):
        got = found(spark, df, q, shard_chars=chars)
        for i, text in queries:
            want = [(k + 1, *x) for k, x in enumerate(scored(docs, text)[:10])]
            assert got.get(i, []) == want
    assert [x[1] for x in got[40]] == list(range(500, 510))


def test_best_positions_stops_early_and_not_too_early():
    rng = np.random.default_rng(3)
    early = 0
    for trial in range(300):
        n, lists, full = 400, [], np.zeros((3, 400), np.int64)
        for i in range(3):
            own = rng.permutation(n)[: rng.integers(1, n)]
            full[i, own] = np.sort(rng.pareto(1.0 + trial % 3, len(own)) * 10).astype(np.int64) + 1
            order = np.lexsort((own, -full[i, own]))
            lists.append((own[order], full[i, own][order]))
        rank = np.full((3, n), -1)
        for i, (d, _) in enumerate(lists):
            rank[i, d] = np.arange(len(d))
        weights = rng.integers(1, 5, 3)
        docs, scores, read = lexical_search.best_positions(lists, weights, lambda x: (rank[:, x], full[:, x]), 10)
        total = weights @ full
        want = np.lexsort((np.arange(n), -total))[: min(10, (total > 0).sum())]
        assert docs.tolist() == want.tolist() and scores.tolist() == total[want].tolist()
        early += read < sum(len(d) for d, _ in lists)
    assert early > 50


def test_search_in_blocks_of_queries(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"a{i % 3} b{i % 5} c{i}") for i in range(60)], "doc_id long, text string")
    q = spark.createDataFrame([(i, f"a{i % 3} b{i % 5}") for i in range(12)], "item_id long, text string")
    want = found(spark, docs, q)
    monkeypatch.setattr(lexical_search, "TOGETHER", 5)
    assert found(spark, docs, q) == want and len(want) == 12


def test_search_odd_rows(spark, odd):
    q = spark.createDataFrame([(1, "a"), (1, "A b"), (None, "X"), (3, ""), (4, "漢字 a1")], "item_id long, text string").withColumn("score", F.lit("mine"))
    path = new_folder(spark, "index")
    lexical_search.build_index(odd, path)
    rows = [(r.item_id, r["rank"], r.doc_id) for r in lexical_search.search(spark, path, q).collect()]
    assert sorted(x for x in rows if x[0] == 1) == [(1, 1, 5), (1, 1, 5), (1, 2, 5), (1, 2, 5), (1, 3, None), (1, 3, None)]
    assert [x[2] for x in sorted(r for r in rows if r[0] is None)] == [None, None] and sorted(x[2] for x in rows if x[0] == 4) == [4, 6]
    empty = new_folder(spark, "index")
    lexical_search.build_index(odd.where("false"), empty)
    assert lexical_search.search(spark, empty, q).count() == 0
    assert lexical_search.search(spark, path, q.where("false")).count() == 0


# -- runs


def brute(x):
    out = {}
    for q in range(1, len(x) // 3 + 1):
        i = 0
        while i < len(x) - q:
            j = i
            while j < len(x) - q and x[j] == x[j + q]:
                j += 1
            if j > i and j - i + q >= max(24, 3 * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, q, n) for (s, n), q in out.items())


def made(rng):
    k, x = rng.choice([1, 2, 3, 30]), []
    for _ in range(rng.randint(0, 6)):
        m = rng.choice([0, 3, 20, 90, rng.randint(1, 200)])
        unit = [rng.randrange(k) for _ in range(m)]
        if unit and rng.random() < 0.3:  # long stretches of one word within a period
            unit = unit[:1] * (m - 1) + [7]
        x += unit * rng.choice([1, 2, 3, 4, 7]) + unit[: rng.randint(0, m)]
        if x and rng.random() < 0.3:
            x[rng.randrange(len(x))] = 99
    return x[:1500]


def test_runs_equal_brute_force():
    rng, total = random.Random(1), 0
    for _ in range(150):
        docs = [made(rng) for _ in range(rng.randint(1, 4))]
        want = [(i, s, n, q) for i, d in enumerate(docs) for s, q, n in brute(d)]
        assert [tuple(r) for r in periodic_runs.runs_of([np.array(d, np.int64) for d in docs]).tolist()] == want
        total += len(want)
    assert total > 500


def test_long_periods_are_found_by_minimizers():
    rng = random.Random(5)
    for q in (33, 64, 65, 127, 128, 129, 1000, 3333):
        unit = [rng.randrange(50) for _ in range(q)]
        for extra in (0, 1, q // 2):
            x = [-2 % 1000] * 3 + (unit * 5)[: 3 * q + extra] + [777]
            got = periodic_runs.runs_of([np.array(x, np.int64)]).tolist()
            assert [r for r in got if r[3] == q and r[2] >= 3 * q + extra], q
        x = (unit * 3)[: 3 * q - 1]
        assert not [r for r in periodic_runs.runs_of([np.array([*x, 998, 999], np.int64)]).tolist() if r[3] == q]


def test_runs_of_very_long_texts_in_time():
    rng = random.Random(6)
    for text in ("a b " * 300_000, " ".join(str(i % 30_011) for i in range(400_000)), " ".join(rng.choice("abcdefgh") for _ in range(400_000)), " ".join(["a"] * 999 + ["b"]) + " " + " ".join((["a"] * 999 + ["b"]) * 400)):
        began = time.time()
        periodic_runs.describe_texts([text])
        assert time.time() - began < 20


def test_run_columns_follow_their_definition(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = {r.doc_id: r for r in QUERIES["op12_periodic_runs"](spark, sf_dir).collect()}
    assert set(rows) == set(docs)
    some = 0
    for i, text in docs.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, h = len(words), zlib.crc32(str(i).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if j < a else words[a + (j - a) % p] for j, w in enumerate(words)]
        if n > 1200:
            continue
        numbers: dict = {}
        runs = brute([numbers.setdefault(w, len(numbers)) for w in words])
        r = rows[i]
        dropped = {j for s, q, m in runs for j in range(s + q, s + m)}
        assert r.n_runs == len(runs) and r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, q, m in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(w for j, w in enumerate(words) if j not in dropped).encode()).hexdigest()
        if runs:
            s, q, m = min(runs, key=lambda x: (-Fraction(x[2], x[1]), x[0], x[1]))
            assert (r.start, r.length, r.period, r.exponent_milli) == (s, m, q, 1000 * m // q)
        else:
            assert (r.start, r.length, r.period, r.exponent_milli) == (None,) * 4
        some += bool(runs)
    assert some > 5


def test_runs_odd_rows(spark, odd):
    empty = hashlib.sha256().hexdigest()
    out = periodic_runs.periodic_runs(odd, plant=True)
    rows = out.collect()
    assert len(rows) == len(ODD) and all(r.collapsed_sha256 == empty and r.n_runs == 0 for r in rows if r.doc_id in (1, 2, 3))
    long = next(r for r in rows if r.doc_id == 7)
    assert (long.n_runs, long.start, long.length, long.period, long.exponent_milli, long.collapsed_sha256) == (1, 0, 5000, 1, 5_000_000, hashlib.sha256(b"word").hexdigest())
    assert periodic_runs.periodic_runs(odd.where("false")).count() == 0


# -- token counts


def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    t.no_truncation()
    t.no_padding()
    return t


def test_counts_equal_the_library(spark, sf_dir):
    t = library()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in QUERIES["op13_token_counts"](spark, sf_dir).collect():
        n = len(t.encode(docs[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 1024)


@pytest.mark.parametrize("together", [True, False])
def test_counts_of_any_words(together):
    t, own, rng = library(), token_counts.TokenCounter(vocabulary("byte_bpe_50k.json")), random.Random(4)
    assert own.together
    own.together = together
    letters = "abcdeZÀÉßΣσİ.,'!?<|>0१²漢́ \n\t\x85\x1c "
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(2000)] + ["a" * 999, "ab" * 3000, "<|endoftext|>" * 3, "x<|endoftext|>'ll", ""]
    texts += ["".join(rng.choice("abehilnorst") for _ in range(n)) for n in (1, 2, 40, 5000)]
    assert own.count(texts).tolist() == [len(t.encode(x, add_special_tokens=False).ids) for x in texts]


def test_counts_after_forgetting_and_of_long_words(monkeypatch):
    own = token_counts.TokenCounter(vocabulary("byte_bpe_50k.json"))
    want = own.count(["some words here", "other words"]).tolist()
    monkeypatch.setattr(token_counts, "MAX_WORDS", 1)
    monkeypatch.setattr(token_counts, "TOGETHER", 4)
    assert [own.count([x])[0] for x in ("some words here", "other words")] == want
    began = time.time()
    assert own.count(["ab" * 200_000 + "c" * 200_001])[0] == len(library().encode("ab" * 200_000 + "c" * 200_001).ids) and time.time() - began < 30


def test_counts_odd_rows(odd):
    t = library()
    rows = token_counts.token_counts(odd, vocabulary("byte_bpe_50k.json"), limit=3).collect()
    assert len(rows) == len(ODD)
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in rows) == sorted((i or -1, len((x or "").encode()), k := len(t.encode(x or "").ids), k > 3) for i, x in ODD)
    assert token_counts.token_counts(odd.where("false"), vocabulary("byte_bpe_50k.json")).count() == 0
