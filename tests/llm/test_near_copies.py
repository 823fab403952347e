"""Near copies against a brute-force search over whole shingle sets."""

import random

import corpus_pipeline
import numpy as np
import pytest

from tidewatch.llm import near_copies


def brute(docs):
    """Each id's group: the least id linked to it by a Jaccard of 0.8 or more."""
    sets = {i: set(near_copies.shingle_hashes(t or "", 5).tolist()) for i, t in docs}
    group = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and (sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))]
    for _ in sets:
        for a, b in links:
            group[a] = group[b] = min(group[a], group[b])
    return group


def family(seed=3):
    """Templates of 120 words with copies at one to four changed places, so that similarities spread about 0.8."""
    rng, docs = random.Random(seed), [(1000, ""), (1001, None), (1002, "two words"), (1003, "TWO  words"), (1004, "two word")]
    for k in range(6):
        base = [f"w{k}x{rng.randrange(10**6)}" for _ in range(120)]
        for c in range(10):
            words = list(base)
            for _ in range(c % 5):
                words[rng.randrange(120)] = f"n{rng.randrange(10**6)}"
            docs.append((100 * k + c, " ".join(words)))
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("crowded,block", [(16, 256), (2, 3)])
def test_groups_equal_brute_force(spark, monkeypatch, crowded, block):
    monkeypatch.setattr(near_copies, "CROWDED", crowded)
    monkeypatch.setattr(near_copies, "BLOCK", block)
    docs = family()
    got = near_copies.near_copy_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == brute(docs)


def test_pipeline_removes_near_copies_that_simhash_misses(spark):
    docs = family()
    rows = [(i, t, "en", "s", len(t or "")) for i, t in docs]
    kept = corpus_pipeline.dedup_near(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "").collect()
    assert {r.doc_id for r in kept} == set(brute(docs).values())


def test_a_block_search_joins_mixed_clusters():
    import pandas as pd

    sets = [np.arange(b, b + 100, dtype=np.uint64) + np.uint64(s) for b in (0, 1000) for s in (0, 8, 16, 50)]
    got = near_copies.forest(pd.DataFrame({"node": range(8), "component": range(8), "data": [s.tobytes() for s in sets]}))
    assert {frozenset(x) for x in zip(got["a"], got["b"])} == {frozenset(x) for x in [(0, 1), (1, 2), (4, 5), (5, 6)]}


def test_repeated_and_null_ids_lose_no_text(spark):
    rows = [(5, "A"), (6, "A"), (6, "B"), (6, "B"), (None, "A"), (None, "C"), (None, "C"), (None, None), (7, "")]
    docs = spark.createDataFrame([(i, t, "en", s, None) for s in ("s", "r") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.dedup_near(spark, docs, "").collect()
    assert sorted((str(r.doc_id), r.text, r.source) for r in kept) == [("5", "A", "r"), ("6", "B", "r"), ("7", "", "r"), ("None", "C", "r")]
    assert corpus_pipeline.dedup_near(spark, docs.where("false"), "").count() == 0


def small_edits():
    """Texts of 900 words and copies with one to four changed words."""
    rng, docs = random.Random(4), []
    for k in range(5):
        base = [f"w{rng.randrange(10**6)}" for _ in range(900)]
        docs += [(10 * k + c, " ".join("changed" if i % 200 == 99 and i < 200 * c else w for i, w in enumerate(base))) for c in range(5)]
    return docs


def test_simhash_candidates_are_the_pairs_within_reach(spark):
    rows = near_copies.hashed(spark.createDataFrame(small_edits() + family(), "doc_id long, text string"), 5).where("n > 0").select("node", "n", "fingerprint").distinct().collect()
    far = lambda x, y: ((x.fingerprint ^ y.fingerprint) & (2**64 - 1)).bit_count()
    fit = [(x, y) for x in rows for y in rows if x.node < y.node and 5 * min(x.n, y.n) >= 4 * max(x.n, y.n)]
    want = {(x.node, y.node) for x, y in fit if 0 < far(x, y) <= near_copies.MOST}
    same = {(x.node, y.node) for x, y in fit if far(x, y) == 0}
    got = {(r.a, r.b) for r in near_copies.simhash_candidates(spark.createDataFrame(rows)).collect()}
    heads = {min(r.node for r in rows if r.fingerprint == x.fingerprint) for x in rows}
    assert len(want) > 10 and got <= want | same and {(a, b) for a, b in want if a in heads and b in heads} <= got


def test_simhash_alone_finds_copies_with_small_edits(spark, monkeypatch):
    """Without the bands, texts of which a few words in 900 differ are still one group each."""
    monkeypatch.setattr(near_copies, "band_keys", lambda hashes: np.zeros(0, np.int64))
    docs = small_edits()
    got = near_copies.near_copy_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == brute(docs) == {i: i // 10 * 10 for i, _ in docs}
