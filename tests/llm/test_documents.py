"""The document operators against brute force, and on nulls, empties, ties, repeats and clashing names."""

import collections
import hashlib
import random
import time
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from compare import connection, same
from pyspark.sql import functions as F

from tidewatch.llm import bpe, buckets, edit_fingerprint, language_id, line_dedup, packing, simhash, transport_stream
from tidewatch.llm.queries import ORACLES, QUERIES, vocabulary

ODD = [(5, "a\nb\nc\nd"), (5, "a\nb\nc\nd"), (None, "x\na\nb\nc\nd"), (1, None), (2, ""), (3, " \n\t"), (4, "ÀÉ ß 漢字 🙂 <|endoftext|> don't"), (7, "word " * 5000), (6, "q\na\nb\nc\nd"), (6, "other")]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    # names that operators might use themselves
    for name in ("row", "hash", "number", "lines", "fingerprint", "piece", "length", "score", "lang_pred", "n", "_v", "key"):
        df = df.withColumn(name, F.lit("mine"))
    return df.withColumn("lang", F.when(F.col("doc_id") > 4, "de").otherwise("en")).withColumn("source", F.lit(None).cast("string")).withColumn("n_chars", F.lit(None).cast("long"))


@pytest.fixture(scope="module")
def texts(sf_dir):
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'").fetchall())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf_dir, name):
    same(QUERIES[name](spark, sf_dir), connection(sf_dir), ORACLES[name])


def test_line_dedup_cases(odd):
    out = line_dedup.dedup_lines(odd, least=0)
    assert out.columns == [*odd.columns, "n_removed"] and out.count() == len(ODD)
    by_text = {r.doc_id: (r.text, r.n_removed) for r in out.collect() if r.doc_id not in (5, 6)}
    assert by_text[1] == (None, 0) and by_text[2] == ("", 0) and by_text[None] == ("x", 4)
    assert sorted((r.text, r.n_removed) for r in out.where("doc_id = 5").collect()) == [("a\nb\nc\nd", 0)] * 2
    assert sorted((r.text, r.n_removed) for r in out.where("doc_id = 6").collect()) == [("other", 0), ("q", 4)]
    assert line_dedup.dedup_lines(odd.where("false")).count() == 0
    # too short for passages
    assert {r.n_removed for r in line_dedup.dedup_lines(odd).collect()} == {0}


def removed(spark, texts, **how):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in sorted(line_dedup.dedup_lines(df, **how).collect(), key=lambda r: r.doc_id)]


def test_line_dedup_finds_passages_of_any_length_at_any_place(spark):
    rng = random.Random(4)
    line = lambda: "".join(rng.choice("abcdef ") for _ in range(30))
    texts, want = [], []
    for n in (2, 3, 4, 5, 9, 30):
        passage = [line() for _ in range(n)]
        for copy in range(4):
            before, after = [line() for _ in range(rng.randrange(4))], [line() for _ in range(rng.randrange(4))]
            texts.append("\n".join([*before, *passage, *after]))
            want.append(texts[-1] if copy == 0 else "\n".join([*before, *after]))
    assert removed(spark, texts, least=0) == want


def test_line_dedup_keeps_each_passage_in_one_piece(spark):
    # b-c is repeated and first in the second text, where a copy of a-b ends
    texts = ["a\nb\n1", "a\nb\nc\n2", "b\nc\n3", "b\n4"]
    assert removed(spark, texts, least=0) == ["a\nb\n1", "b\nc\n2", "3", "b\n4"]
    words = " ".join(f"w{i}" for i in range(51))
    assert removed(spark, [f"x\n{words}", f"{words}\ny", words, "x", "y"], least=0) == [f"x\n{words}", "y", "", "x", "y"]
    assert removed(spark, ["p\n\nq\n1\n\n\n\n2", "p\n \nq\n\n\n\n3"], least=0) == ["p\n\nq\n1\n\n\n\n2", "\n\n\n3"]
    assert removed(spark, ["s\n" * 5], least=0) == ["s\ns\n"]


def test_a_hash_of_different_lines_removes_nothing(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "line_hash", lambda x: F.length(x).cast("long"))
    texts = ["aa\nbbb\ncccc", "xx\nyyy\ncccc\nddddd", "zzzzzzz\ncccc\nddddd", "kkkkkkkk\nkkkkkkkkk", "kkkkkkkk\nkkkkkkkkk"]
    assert removed(spark, texts, least=0) == [*texts[:2], "zzzzzzz\ncccc\nddddd", "kkkkkkkk\nkkkkkkkkk", ""] or removed(spark, texts, least=0) == [*texts[:2], "zzzzzzz", "kkkkkkkk\nkkkkkkkkk", ""]


def test_line_dedup_removes_passages_and_leaves_pairs_that_texts_share_by_chance(spark):
    rng = random.Random(7)
    line = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    texts, want = [], []
    for words in ((9, 9, 9, 9, 9, 9), (40, 12), (1, 1, 50), (5,) * 12, (1,) * 60, (3, 1) * 20, (2, 2, 5, 4, 1)):
        passage = [line(n) for n in words]
        for copy in range(3):
            before, after = [line(1), "Yes.", "No.", line(rng.randrange(1, 9))], [line(rng.randrange(1, 9)), "Yes.", "No."]
            texts.append("\n".join([*before, *passage, *after]))
            want.append(texts[-1] if copy == 0 else "\n".join([*before, *after]))
    assert removed(spark, texts) == want


def test_line_dedup_equals_its_sql_on_few_words(spark):
    # few different lines, of few words: windows, chunks of all scales, ties and stretches that touch
    rng = random.Random(11)
    few = [" ".join(rng.choice("uvwxyz") for _ in range(rng.choice((1, 1, 2, 2, 3, 8)))) for _ in range(40)] + ["", " \t", "\r", "k " * 60]
    texts = [(i, "\n".join(rng.choice(few) for _ in range(rng.randrange(60)))) for i in range(150)]
    for i in range(0, 150, 5):
        part = texts[rng.randrange(150)][1].split("\n")[2:30]
        texts.append((200 + i, "\n".join(["top", *part, "end"])))
    documents = pd.DataFrame(texts, columns=["doc_id", "text"])
    want = duckdb.connect().register("documents", documents).sql(line_dedup.ORACLE).fetchall()
    got = line_dedup.dedup_lines(spark.createDataFrame(texts, "doc_id long, text string"))
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and sum(r[2] for r in want) > 100
    assert line_dedup.chunks(spark.createDataFrame(texts, "doc_id long, text string")).where("NOT window").select(F.col("b") % 16).distinct().count() == 2


def test_line_dedup_of_a_very_long_text_is_linear(spark):
    lines = [str(i) for i in range(60_000)]
    assert removed(spark, ["\n".join(lines), "\n".join(["x", *lines[:30_000:1], "y"])])[1] == "x\ny"


def tokenizer(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary(name))
    t.no_truncation()
    t.no_padding()
    return t


def fuzz(n=3000, seed=2):
    rng, letters = random.Random(seed), "abcdeZÀÉßΣσİ.,'!?<|>0१²漢́ \n\t\x85\x1c "
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(n)] + ["aaaa" * 500, "<|endoftext|>" * 3, "don't we'll I'm", "<|startoftext|>b."]


def test_bpe_equals_the_library(texts):
    t, own = tokenizer("byte_bpe_50k.json"), bpe.ByteBPE(vocabulary("byte_bpe_50k.json"))
    many = [*fuzz(), *[x for x in texts.values() if x][:60]]
    for text, ids in zip(many, own.encode(many)):
        want = t.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want and own.decode(ids) == t.decode(want, skip_special_tokens=False)


def test_bpe_verification_catches_every_wrong_guess():
    own = bpe.ByteBPE(vocabulary("byte_bpe_50k.json"))
    rng = random.Random(1)
    words = ["".join(rng.choice("abehilnorst") for _ in range(rng.randint(1, 50))) for _ in range(3000)]
    wrong = sum(own.greedy(w.encode()) != own.merged(w.encode()) for w in words)
    assert wrong > 100
    assert own.encode_words(words) == [own.merged(w.encode()) for w in words]


def test_bpe_of_very_long_words(texts):
    t, own = tokenizer("byte_bpe_50k.json"), bpe.ByteBPE(vocabulary("byte_bpe_50k.json"))
    rng = random.Random(3)
    for letters in ("etaoinshrdlu", "a", "ab", "漢字é"):
        word = "".join(rng.choice(letters) for _ in range(60_000))
        assert own.encode([word])[0].tolist() == t.encode(word, add_special_tokens=False).ids
    began = time.process_time()
    own.merged("".join(rng.choice("etaoinshrdlu") for _ in range(1_000_000)).encode())
    assert time.process_time() - began < 60


def test_bpe_columns_round_trip(odd):
    path = vocabulary("byte_bpe_50k.json")
    out = bpe.decode_column(bpe.encode_column(odd, path), path, text="back")
    assert out.where("back <> coalesce(text, '')").count() == 0
    assert bpe.bpe_digests(odd, path).count() == len(ODD) and bpe.bpe_digests(odd.where("false"), path).count() == 0


def test_packing_equals_the_library_and_fits(spark, odd, texts):
    t = tokenizer("word_bpe_49k.json")
    own = packing.WordTokenizer(vocabulary("word_bpe_49k.json"))
    many = fuzz()
    assert [x.tolist() for x in own.encode(many)] == [t.encode(x, add_special_tokens=False).ids for x in many]
    rows = spark.createDataFrame([*ODD, *texts.items()], "doc_id long, text string")
    out = packing.pack_documents(rows, vocabulary("word_bpe_49k.json")).collect()
    want = collections.Counter()
    for i, x in [*ODD, *texts.items()]:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            want[i, k // 2048, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    bins = collections.defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        b.sort()
        assert b[0][0] == 0 and all(x + n == y for (x, n), (y, _) in zip(b, b[1:])) and sum(n for _, n in b) <= 2048
    assert len(bins) <= 1.02 * sum(r.length for r in out) / 2048 + 1


def test_packing_plan_takes_exact_complements():
    assert packing.plan({7: 3, 3: 3}, 10) == [((7, 3), 3)]
    assert packing.plan({6: 2, 3: 2, 1: 2}, 10) == [((6, 3, 1), 2)]
    assert packing.plan({6: 1, 2: 1, 1: 2}, 10) == [((6, 2, 1, 1), 1)]
    rng = random.Random(3)
    for _ in range(30):
        hist = {rng.randint(1, 50): rng.randint(1, 40) for _ in range(20)}
        used = collections.Counter()
        for p, k in packing.plan(hist, 50):
            assert sum(p) <= 50 and k > 0
            for x in p:
                used[x] += k
        assert used == collections.Counter(hist)
    assert packing.plan({}, 10) == []


def fewest(lengths, capacity):
    """The least number of sequences that hold all lengths, by exhaustive search."""
    best = [len(lengths)]

    def put(left, gaps):
        if len(gaps) >= best[0]:
            return
        if not left:
            best[0] = len(gaps)
            return
        x, rest = left[0], left[1:]
        for g in sorted({g for g in gaps if g >= x}):
            k = gaps.index(g)
            put(rest, gaps[:k] + [g - x] + gaps[k + 1 :])
        put(rest, [*gaps, capacity - x])

    put(sorted(lengths, reverse=True), [])
    return best[0]


def test_packing_plan_against_exhaustive_search():
    hist = {1000: 1, 900: 1, 748: 1, 648: 1, 400: 2}
    assert sum(k for _, k in packing.plan(hist, 2048)) == 2
    assert sum(k for _, k in packing.plan({x: 1000 * n for x, n in hist.items()}, 2048)) == 2000
    assert sum(k for _, k in packing.plan({5: 40, 4: 40, 3: 40, 2: 40, 6: 40}, 20)) == 40  # no length above half of the capacity
    rng, over = random.Random(9), 0
    for _ in range(60):
        lengths = [rng.randint(1, 20) for _ in range(rng.randint(1, 10))]
        got, want = sum(k for _, k in packing.plan(dict(collections.Counter(lengths)), 20)), fewest(lengths, 20)
        assert want <= got <= want + 1
        over += got > want
    assert over <= 3


def test_packing_is_never_worse_than_best_fit():
    rng = random.Random(12)
    for trial in range(40):
        hist = {rng.randint(1, 2048): rng.randint(1, 30) for _ in range(rng.randint(5, 60))}
        n = np.zeros(2049, np.int64)
        for length, count in hist.items():
            n[length] += count
        patterns, used = packing.plan(hist, 2048), collections.Counter()
        assert sum(k for _, k in patterns) <= sum(k for _, k in packing.best_fit(n))
        for lengths, k in patterns:
            assert sum(lengths) <= 2048
            for x in lengths:
                used[x] += k
        assert used == hist
        rest = n.copy()
        assert all(sum(p) == 2048 for p, _ in packing.exact_complements(rest)) and (rest >= 0).all()


def test_packing_of_rows_that_are_alike(spark):
    rows = spark.createDataFrame([(None, 0, 700)] * 400, "doc_id long, piece int, length long").repartition(6)
    out = packing.place(rows).collect()
    assert len({(r.sequence_id, r.offset) for r in out}) == 400 and len({r.sequence_id for r in out}) == 200


def brute_fingerprint(text, k):
    from xxhash import xxh64_intdigest

    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([b" ".join(w)] if w else [])
    h = [xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(prints, most):
    ids = sorted(prints)
    label = {i: i for i in ids}
    changed = True
    near = {i: [j for j in ids if (prints[i] ^ prints[j]).bit_count() <= most] for i in ids}
    while changed:
        changed = False
        for i in ids:
            m = min(label[j] for j in near[i])
            if m < label[i]:
                label[i], changed = m, True
    return label


@pytest.mark.parametrize(("shingle", "most", "crowded", "block"), [(3, 2, 128, 4096), (5, 5, 128, 4096), (3, 9, 2, 7)])
def test_simhash_equals_brute_force(spark, sf_dir, texts, monkeypatch, shingle, most, crowded, block):
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    monkeypatch.setattr(simhash, "BLOCK", block)
    prints = {i: brute_fingerprint(x, shingle) for i, x in texts.items()}
    label = brute_groups(prints, most)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle, most).collect()}
    assert got == {i: (f"{prints[i]:016x}", label[i]) for i in texts}


def test_simhash_cases(odd):
    rows = simhash.simhash_groups(odd).collect()
    assert len(rows) == len(ODD)
    zero = {r.component_id for r in rows if r.fingerprint == "0" * 16}
    assert zero == {1}  # null, empty and blank texts are linked
    assert simhash.simhash_groups(odd.where("false")).count() == 0


def test_thresholds_obey_the_pigeonhole_rule():
    rng = np.random.RandomState(0)
    sample = rng.randint(0, 2**63, 500).astype(np.uint64)
    for most in (1, 2, 5):
        for m in range(1, most + 2):
            groups = simhash.group_bits(np.full((64, 64), 250.0) + 250 * np.eye(64), 1000, m)
            assert sorted(b for g in groups for b in g) == list(range(64))
            ts, _ = simhash.allocate(sample, groups, most, 10_000)
            assert not ts or sum(ts) == most - m + 1


def test_language_held_out_accuracy(spark, sf_dir, odd):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language_id.fit(docs)
    out = language_id.identify(docs, model).where(language_id.held_out())
    good, n = out.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 20 and good / n > 0.95
    cases = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in language_id.identify(odd, model).collect()}
    assert cases[(1, None)] == ("und", 0.0) and cases[(3, " \n\t")] == ("und", 0.0)
    assert all(0 <= s <= 1 for _, s in cases.values())
    assert {r.lang_pred for r in language_id.identify(docs.limit(3), language_id.fit(docs.where("false"))).collect()} == {"und"}


def brute_language(texts, labels, chosen, asked):
    """The kernel, its Nystroem features and the ridge regression written out with sets of n-grams."""
    grams = lambda t: {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}
    marks = [grams(t) for t in chosen]
    alphabet = set().union(*marks)
    rows = lambda ts: [grams(t.lower()) & alphabet for t in ts]
    norm = lambda g: max(len(g), 1) ** 0.5
    kernel = lambda a: np.array([[len(x & m) / norm(x) / norm(m) for m in marks] for x in a])
    w, v = np.linalg.eigh(kernel(marks))
    good = w > 1e-6 * w.max()
    whiten = v[:, good] / np.sqrt(w[good])
    z = np.hstack([kernel(rows(texts)) @ whiten, np.ones((len(texts), 1))])
    classes = sorted(set(labels))
    y = np.array([[1.0 if x == c else -1.0 for c in classes] for x in labels])
    s = np.array([len(labels) / (len(classes) * labels.count(x)) for x in labels])[:, None]
    penalty = language_id.RIDGE * np.eye(z.shape[1]) * len(z) / len(classes)
    penalty[-1, -1] = 0
    weights = np.linalg.solve(z.T @ (s * z) + penalty + 1e-9 * np.eye(len(penalty)), z.T @ (s * y))
    f = language_id.SHARPNESS * (np.hstack([kernel(rows(asked)) @ whiten, np.ones((len(asked), 1))]) @ weights)
    p = np.exp(f - f.max(1, keepdims=True))
    return [classes[i] for i in p.argmax(1)], (p / p.sum(1, keepdims=True)).max(1)


@pytest.mark.parametrize("slots", [1 << 22, 1])  # by a table, and by the sorted n-grams
def test_language_kernel_equals_brute_force(texts, monkeypatch, slots):
    monkeypatch.setattr(language_id, "SLOTS", slots)
    monkeypatch.setattr(language_id, "BATCH_CELLS", 50_000)
    some = [t for t in texts.values() if t][:60]
    han = ["".join(chr(0x4E00 + (i * 31 + k * 7) % 300) for k in range(80)) for i in range(20)]
    learned, labels = [*some[:30], *han], ["x"] * 15 + ["y"] * 15 + ["zh"] * 20
    model = language_id.KernelModel(learned, labels, landmarks=12)
    chosen = [language_id.passage(learned[i].lower(), i) for i in (0, 1, 2, 3, 15, 16, 17, 18, 30, 31, 32, 33)]
    asked = [*some, *han, "A.", "Ж", "12"]
    got, want = model.predict(asked), brute_language(learned, labels, chosen, asked)
    assert np.allclose(got[1][:-1], want[1][:-1], atol=2e-3) and got[1][-1] == 0 and got[0][-1] == "und"
    assert [a for a, p in zip(got[0][:-1], want[1]) if p > 0.51] == [b for b, p in zip(want[0][:-1], want[1]) if p > 0.51]
    marks = {t[i : i + 3] for t in chosen for i in range(len(t) - 2)}
    share = [sum(t[i : i + 3] in marks for i in range(len(t) - 2)) / (len(t) - 2) if len(t) > 2 else 1.0 for t in (x.lower() for x in asked[:-1])]
    assert np.allclose(got[2][:-1], share)


def test_a_model_is_bounded_whatever_the_script():
    rng = random.Random(2)
    many = ["".join(chr(rng.randrange(0x4E00, 0x9F00)) for _ in range(20_000)) for _ in range(100)]
    model = language_id.KernelModel(many[:40], ["a"] * 20 + ["b"] * 20)
    assert len(model.columns) <= language_id.LANDMARKS * language_id.LANDMARK_CHARS * 3
    assert model.predict(many[:2])[0] == ["a", "a"]


def test_pipeline_rejects_what_was_not_learned(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rng = random.Random(5)
    noise = ["мы сегодня пошли гулять в парк и вернулись домой", "我们今天去公园散步然后回家", "".join(rng.choice("qwertyuiopasdfghjklzxcvbnm") for _ in range(300)), rng.randbytes(200).hex()]
    more = spark.createDataFrame([(10**9 + i, t, None, "s", len(t)) for i, t in enumerate(noise)], docs.schema)
    kept = {r.doc_id for r in corpus_pipeline.identify_language(spark, docs.unionByName(more), sf_dir).select("doc_id").collect()}
    clean = {r.doc_id for r in docs.where("length(text) > 20").collect()}
    assert clean <= kept and not any(i >= 10**9 for i in kept)


def test_transport_stream_round_trip(odd):
    rng = random.Random(5)
    for n in [1, 2, 150, 169, 170, 171, 183, 184, 185, 352, 353, 354, 30_720, 30_721, 100_000, *[rng.randint(1, 1000) for _ in range(200)]]:
        payload = rng.randbytes(n)
        stream = transport_stream.mux(payload)
        back, info = transport_stream.demux(stream)
        assert back == payload and info["lost"] == 0 and len(stream) % 188 == 0
        assert info["pes"] == -(-n // transport_stream.PES_BYTES) and [t for _, t in info["access"]] == info["pts"][:: transport_stream.EVERY]
    long = transport_stream.mux(bytes(100_000))
    parts = [long[i : i + 188] for i in range(0, len(long), 188)]
    with pytest.raises(transport_stream.StreamError):
        transport_stream.demux(b"".join(parts[:5] + parts[6:]))
    with pytest.raises(transport_stream.StreamError):
        transport_stream.demux(b"x" + long[1:])
    twice = list(parts)
    twice[5] = twice[5][:3] + bytes([twice[5][3] & 0xF0 | (twice[5][3] + 3) & 15]) + twice[5][4:]
    with pytest.raises(transport_stream.StreamError):  # counters that break within a PES packet
        transport_stream.demux(b"".join(twice))
    rows = transport_stream.media_features(odd).collect()
    assert len(rows) == len(ODD) and {r.payload_bytes % 192 for r in rows} == {0} and min(r.payload_bytes for r in rows) == 192
    assert transport_stream.media_features(odd.where("false")).count() == 0


def packet(pid, counter, data, unit=False, field=None):
    """One packet; the adaptation field is stuffed so that the data fill the rest."""
    room = 184 - len(data)
    head = bytes([0x47, (0x40 if unit else 0) | pid >> 8, pid & 255, (0x30 if room else 0x10) | counter & 15])
    return head + (b"" if not room else bytes([room - 1]) + ((field or b"\x00") + b"\xff" * 183)[: room - 1]) + data


def scalar_stream(payload):
    """The stream of ``transport_stream.mux``, packet by packet."""
    out, counter, tables = [], 0, 0
    for k in range(-(-len(payload) // transport_stream.PES_BYTES)):
        data, t = payload[k * transport_stream.PES_BYTES :][: transport_stream.PES_BYTES], k * 3003
        if k % 4 == 0:
            for pid, section in ((0, transport_stream.PAT), (256, transport_stream.PMT)):
                out.append(bytes([0x47, 0x40 | pid >> 8, pid & 255, 0x10 | tables & 15, 0]) + section + b"\xff" * (183 - len(section)))
            tables += 1
        bits = f"{t:033b}"
        stamp = int(f"0010{bits[:3]}1{bits[3:18]}1{bits[18:]}1", 2).to_bytes(5, "big")
        pes = b"\0\0\1\xbd" + (len(data) + 8).to_bytes(2, "big") + b"\x80\x80\x05" + stamp + data
        field = b"\x50" + int(f"{bits}111111000000000", 2).to_bytes(6, "big") if k % 4 == 0 else None
        unit = True
        while pes:
            part = pes[: 184 - (8 if unit and field else 0)]
            out.append(packet(257, counter, part, unit, field if unit else None))
            pes, counter, unit = pes[len(part) :], counter + 1, False
    return b"".join(out)


def section(table, number, body):
    head = bytes([table]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\0\0"
    return head + body + transport_stream.crc32_mpeg(head + body).to_bytes(4, "big")


def test_streams_of_several_programs_long_tables_duplicates_and_jumps():
    pat = section(0, 1, b"".join(n.to_bytes(2, "big") + (0xE000 | pid).to_bytes(2, "big") for n, pid in ((0, 16), (7, 300), (9, 301))))
    long = section(2, 7, b"\xe1\x00" + (0xF000 | 400).to_bytes(2, "big") + bytes(400) + b"\x06\xe1\x90\xf0\x02ab" + b"\x1b\xe1\x91\xf0\x00")  # over several packets
    short = section(2, 9, b"\xe1\x00\xf0\x00\x06\xe1\x92\xf0\x00")
    pes = lambda data: b"\0\0\1\xbd" + (len(data) + 3).to_bytes(2, "big") + b"\x80\x00\x00" + data
    tables = [packet(0, 0, b"\0" + pat, True)] + [packet(300, i, x, i == 0) for i, x in enumerate([b"\0" + long[:183], long[183:367], long[367:]])] + [packet(301, 0, b"\0" + short, True)]
    a, b = pes(bytes(range(200))), pes(b"second")
    first = [packet(400, 3, a[:184], True), packet(400, 4, a[184:])]
    stream = [*tables, packet(8191, 5, bytes(184)), first[0], first[0], packet(402, 0, b, True), first[1], packet(8191, 9, bytes(184)), packet(400, 9, pes(b"x" * 20), True, b"\x80")]
    payload, info = transport_stream.demux(b"".join(stream))
    assert payload == bytes(range(200)) + b"x" * 20 and info["lost"] == 0 and info["duplicates"] == 1 and info["programs"] == 2
    assert info["streams"] == {7: [(400, 6), (401, 0x1B)], 9: [(402, 6)]}
    assert transport_stream.demux(b"".join(stream), program=9)[0] == b"second"
    with pytest.raises(transport_stream.StreamError):  # a packet within a PES packet is missing though its length fits
        transport_stream.demux(b"".join([*tables, packet(400, 3, a[:100], True), packet(400, 5, a[100:])]))
    with pytest.raises(transport_stream.StreamError):
        transport_stream.demux(b"".join(stream), program=5)


def test_media_query_equals_brute_force(spark, sf_dir, texts):
    for r in QUERIES["op7_transport_stream"](spark, sf_dir).collect():
        raw = (texts[r.doc_id] or "").encode()
        payload = raw.ljust(max(192, -(-len(raw) // 192) * 192), b" ")
        media, n = scalar_stream(payload), -(-len(payload) // transport_stream.PES_BYTES)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        points = "/".join(f"{k}@{k * 3003}" for k in range(0, n, 4))
        assert r.feature == f"packets={len(media) // 188};programs=1;pid=257;type=6;pes={n};pts=0-{(n - 1) * 3003};access={points};lost=0"
        assert r.pts == [k * 3003 for k in range(n)] and [(x.pes, x.pts) for x in r.access_points] == [(k, k * 3003) for k in range(0, n, 4)]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))


def test_edit_fingerprints(spark, sf_dir, texts):
    rows = QUERIES["op9_edit_fingerprint"](spark, sf_dir).collect()
    order = sorted(texts, reverse=True)
    after = dict(zip(order, order[1:] + order[:1]))
    assert len(rows) == len(texts)
    for r in rows:
        a, b = texts[r.doc_id] or "", texts[after[r.doc_id]] or ""
        k = len(a) // 3
        assert r.edited_sha256 == hashlib.sha256((a[: len(a) - k] + b[:k]).encode()).hexdigest() and r.n_chars == len(a)
    far = np.mean([r.near_next for r in rows])
    assert np.mean([r.near_edited for r in rows]) > 0.6 and far < 0.2


def test_edit_fingerprint_cases(spark, odd):
    rows = edit_fingerprint.edit_fingerprints(odd).collect()
    assert len(rows) == len(ODD)
    same_text = {r.fingerprint for r in rows if r.doc_id == 5}
    assert len(same_text) == 1
    single = edit_fingerprint.edit_fingerprints(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).first()
    assert single.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and single.near_next == 1.0
    assert edit_fingerprint.edit_fingerprints(odd.where("false")).count() == 0


def test_walk_follows_edits():
    w, rng = edit_fingerprint.walker(), random.Random(2)
    a = "".join(rng.choice("abcdefghij klmnop") for _ in range(4000))
    b = a[:1000] + "xyz" + a[1000:2500] + a[2510:]
    c = "".join(rng.choice("abcdefghij klmnop") for _ in range(4000))
    fa, fb, fc = w.fingerprints([a, b, c])
    assert edit_fingerprint.likeness(fa, fb) > 0.5 > 0.3 > edit_fingerprint.likeness(fa, fc)
    assert w.fingerprints([b, "", a])[2] == fa  # company in a batch makes no difference


def scalar_walk(text, end_marks=()):
    """The walk a step at a time: the character shown at each time."""
    shown, t = [], 0
    for c in text:
        kind = int(edit_fingerprint._mix(np.array([ord(c)]))[0]) % edit_fingerprint.CLASSES
        while True:
            shown.append(c)
            coin = t % edit_fingerprint.PERIOD == 0 or int(edit_fingerprint._mix(np.array([t % edit_fingerprint.PERIOD * edit_fingerprint.CLASSES + kind]))[0]) & 1
            t += 1
            if coin:
                break
    return shown


def scalar_fingerprint(text):
    shown, out, octave = scalar_walk(text), "", 0
    while shown and (octave == 0 or edit_fingerprint.FIRST << octave - 1 < len(shown)):
        for t in edit_fingerprint.sample_times(octave).tolist():
            h = (ord(shown[t]) * 0x9E3779B97F4A7C15 + t) % 2**64 if t < len(shown) else None
            out += "-" if h is None else f"{int(edit_fingerprint._mix(np.array([h], np.uint64))[0]) >> 7 & 15:x}"
        octave += 1
    return out


def scalar_likeness(a, b):
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    n, same, held = max(len(a), len(b)), 0.0, 0.0
    for i in range(n):
        x, y = a[i : i + 1] or "-", b[i : i + 1] or "-"
        weight = edit_fingerprint.FIRST * 2.0 ** max(i // 64 - 1, 0) / 64
        held += weight * (x != "-" or y != "-")
        same += weight * (x == y != "-")
    return max(0.0, (same / held - 1 / 16) / (15 / 16))


def test_edit_fingerprint_query_equals_brute_force(spark, sf_dir, texts):
    rows = QUERIES["op9_edit_fingerprint"](spark, sf_dir).collect()
    order = sorted(texts, reverse=True)
    after = dict(zip(order, order[1:] + order[:1]))
    prints = {r.doc_id: r.fingerprint for r in rows}
    checked = 0
    for r in rows:
        a, b = texts[r.doc_id] or "", texts[after[r.doc_id]] or ""
        if len(a) < 3000:
            checked += 1
            k = len(a) // 3
            assert r.fingerprint == scalar_fingerprint(a) and r.edited_fingerprint == scalar_fingerprint(a[: len(a) - k] + b[:k])
        assert r.near_edited == pytest.approx(scalar_likeness(r.fingerprint, r.edited_fingerprint)) and r.near_next == pytest.approx(scalar_likeness(r.fingerprint, prints[after[r.doc_id]]))
    assert checked > 50


def edit_family(seed=8):
    """Texts in families of edited copies, so that likenesses spread about the bound, also of copies of copies."""
    rng, out = random.Random(seed), []
    for k in range(12):
        text = "".join(rng.choice("abcdefghijklmnop ") for _ in range(rng.choice([300, 900, 1500])))
        for _ in range(9):
            out.append(text)
            for _ in range(rng.randrange(4)):
                i = rng.randrange(len(text))
                text = text[:i] + rng.choice(["", "Q", "xyz"]) + text[i + rng.randrange(3) :]
    return out


@pytest.mark.parametrize(("crowded", "block"), [(16, 128), (2, 3)])
def test_near_groups_against_all_pairs(spark, monkeypatch, crowded, block):
    monkeypatch.setattr(edit_fingerprint, "CROWDED", crowded)
    monkeypatch.setattr(edit_fingerprint, "BLOCK", block)
    texts = edit_family()
    prints = edit_fingerprint.walker().fingerprints(texts)
    want, near, missed = list(range(len(texts))), [], 0
    for i in range(len(texts)):
        near += [(i, j) for j in range(i) if edit_fingerprint.likeness(prints[i], prints[j]) >= edit_fingerprint.LEAST]
    for _ in texts:
        for i, j in near:
            want[i] = want[j] = min(want[i], want[j])
    got = {r.doc_id: r.near_group for r in edit_fingerprint.near_edits(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    missed = sum(got[i] != got[j] for i, j in near)
    assert len(near) > 100 and missed <= 0.01 * len(near)
    assert all(want[i] == want[g] for i, g in got.items())  # and no link that isn't one


def test_unlike_texts_that_share_bands_are_not_verified(spark, monkeypatch):
    """Texts of few frequent letters agree on bands by chance; sketches tell them before any fingerprint is fetched."""
    rng, seen = random.Random(6), []
    texts = ["".join(rng.choices("eatonrsh ", [40, 9, 8, 7, 6, 5, 5, 5, 15], k=rng.randrange(500, 900))) for _ in range(400)]
    verified = buckets.verified

    def counted(pairs, *rest):
        seen.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(buckets, "verified", counted)
    out = edit_fingerprint.near_edits(spark.createDataFrame(list(enumerate(texts + texts[:1])), "doc_id long, text string")).collect()
    assert len(out) == 401 and sum(r.near_group != r.doc_id for r in out) == 1
    assert len(seen) == 1 and seen[0] < 100


def test_sketches_keep_all_that_are_alike():
    w, texts = edit_fingerprint.walker(), edit_family(9)
    prints = w.fingerprints(texts)
    rows = edit_fingerprint.band_rows(prints, np.arange(len(texts)))
    both = rows.merge(rows, on="key", suffixes=("", "_m"))
    apart = sum(np.bitwise_count((lambda x: x & np.uint64(0x1111111111111111))((lambda x: x | x >> np.uint64(2))((lambda x: x | x >> np.uint64(1))((both[s] ^ both[s + "_m"]).to_numpy().view(np.uint64))))) for s in ("s1", "s2"))
    passed = set(zip(both["node"][apart <= edit_fingerprint.UNLIKE], both["node_m"][apart <= edit_fingerprint.UNLIKE]))
    near = {(i, j) for i in range(len(texts)) for j in range(i) if edit_fingerprint.likeness(prints[i], prints[j]) >= edit_fingerprint.LEAST}
    assert len(near) > 100 and len(near - passed) <= 0.01 * len(near)


def test_a_bucket_of_mixed_clusters_loses_no_link(spark):
    """One bucket of many members: clusters, chains and single members, joined as by all pairs."""
    rng = random.Random(2)
    points = {i: x for i, x in enumerate(sorted(rng.uniform(0, 400) for _ in range(300)))}
    keyed = spark.createDataFrame([(7, i) for i in points] + [(8, i) for i in list(points)[:5]], "key long, node long")
    near = lambda x, y: np.abs(x.to_numpy() - y.to_numpy()) <= 1

    def forest(pdf):
        x, c, node = pdf["data"].to_numpy(), pdf["component"].to_numpy(), pdf["node"].to_numpy()
        i, j = np.nonzero((np.abs(x[:, None] - x[None]) <= 1) & (c[:, None] != c[None]))
        return pd.DataFrame({"a": node[i], "b": node[j]})

    payload = lambda wanted: spark.createDataFrame(list(points.items()), "node long, data double").join(wanted, "node", "left_semi")
    got = {r.node: r.component for r in buckets.linked(keyed, payload, near, forest, 4, 16).collect()}
    want = {0: 0}
    for i in range(1, len(points)):
        want[i] = want[i - 1] if points[i] - points[i - 1] <= 1 else i
    assert len(set(want.values())) > 20 and {i: got.get(i, i) for i in points} == want


def test_rows_without_ids_and_of_one_id_are_dealt(spark):
    rows = [(None, f"text {i}") for i in range(60)] + [(5, f"other {i}") for i in range(40)] + [(5, "other 1"), (9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = edit_fingerprint.near_edits(df).collect()
    assert len(out) == len(rows) and {r.near_group for r in out if r.doc_id is None} <= {None, 5}
    dealt = edit_fingerprint.in_order(df)
    assert dealt.select("bucket").distinct().count() >= 8 and dealt.where("NOT guard").count() == len(rows)
