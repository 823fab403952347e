"""WARC, main text, quotation links and the pipeline."""

import html
import re
import time

import duckdb
import pytest
from compare import same
from pyspark.sql import functions as F

import corpus_pipeline
from tidewatch.llm import html_text, packing, quote_links, shared, warc
from tidewatch.llm.queries import QUERIES


def test_archive_gives_the_records_back(spark):
    big = "<p>" + "é" * 80 + "</p>"
    rows = [(3, "u3", big), (1, "u1", big), (2, "u2", "small"), (4, "u4", "small"), (5, None, None), (None, "n", big), (1, "again", big)]
    path = shared.new_folder(spark, "t")
    warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("mine")), path)
    assert spark.read.parquet(f"{path}/payloads").count() == 3  # each payload once
    records = warc.record_bytes(warc.read_archive(spark, path)).collect()
    assert len(records) == len(rows)
    for r in records:
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\n") and rest.endswith(b"\r\n\r\n")
        assert int(re.search(rb"Content-Length: (\d+)", head)[1]) == len(rest) - 4
    got = sorted((str(r.key), r.record_type, r.refers_to, r.payload_bytes) for r in warc.parse_records(warc.read_archive(spark, path)).collect())
    n = len(big.encode())
    assert got == sorted([("1", "response", None, n), ("1", "response", None, n), ("3", "revisit", 1, n), ("None", "revisit", 1, n), ("2", "response", None, 5), ("4", "response", None, 5), ("5", "response", None, 0)])


def test_fields_survive_any_uri(spark):
    urls = ["http://a/\u2028X-Key: 99", "b\r\nX-Key: 98\r\n", "c\u2029X-Key: 97", "d\x85X-Key: 96", "e\nX-Key: 95\rX-Key: 94", "\x00\x7f é%"]
    path = shared.new_folder(spark, "t")
    warc.write_archive(spark.createDataFrame([(i, u, f"page {i}") for i, u in enumerate(urls)], "page_id long, url string, html string"), path)
    records = warc.read_archive(spark, path)
    assert sorted(r.key for r in warc.parse_records(records).collect()) == list(range(len(urls)))
    heads = {bytes(r.header).decode() for r in records.collect()}
    assert any("WARC-Target-URI: http://a/%E2%80%A8X-Key: 99\r\n" in h for h in heads) and any("WARC-Target-URI: %00%7F é%\r\n" in h for h in heads)
    for r in warc.record_bytes(records).collect():
        message = bytes(r.record).partition(b"\r\n\r\n")[2]
        assert message.startswith(b"HTTP/1.1 200 OK\r\n") and message.endswith(bytes(r.payload) + b"\r\n\r\n")


def test_damaged_payload_is_noticed(spark):
    path = shared.new_folder(spark, "t")
    warc.write_archive(spark.createDataFrame([(1, "u", "x" * 200)], "page_id long, url string, html string"), path)
    bad = spark.read.parquet(f"{path}/payloads").withColumn("block", F.encode(F.lit("other"), "UTF-8"))
    bad.write.parquet(f"{path}/bad/payloads")
    spark.read.parquet(f"{path}/headers").write.parquet(f"{path}/bad/headers")
    with pytest.raises(Exception, match="corrupt payload"):
        warc.parse_records(warc.read_archive(spark, f"{path}/bad")).collect()


def test_main_text_of_the_pages(spark, sf_dir):
    pages = dict(duckdb.sql(f"SELECT page_id, html FROM '{sf_dir}/pages.parquet'").fetchall())
    for r in QUERIES["op8_html_text"](spark, sf_dir).collect():
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)
        assert r.text == " ".join(html.unescape(re.sub(r"<[^>]*>", " ", article[1])).split()) and r.n_chars == len(r.text)


TREE = html_text.Tree(html_text.labelled())
LONG = "This is a long paragraph of plain text with more than twenty words in it, so that anyone would call it main text and keep it."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""), ("<script>var a='<p>x</p>'</script>", ""), ("<article><p>a<b>b</b>c &amp; d</p><p>e</article>", "abc & d e"),
        (f"<nav><a href=x>Home</a></nav><main><h1>Title</h1><p>{LONG}</p><div class='comments'><p>{LONG}</p></div><form>Name <input></form></main><footer>{LONG}</footer>", f"Title {LONG}"),
        (f"<body><div class='cookie-notice'>{LONG}</div><div><p>{LONG}</p><p>{LONG}</p></div><div id=menu><a href=a>One</a> <a href=b>Two</a></div></body>", f"{LONG} {LONG}"),
        ("<article><p>A first paragraph.</p><video src=x><p>Second one here.</p><object><p>Third.</p></article>", "A first paragraph. Second one here. Third."),
        ("<article><p>a</p><video>old browser</video><svg><text>s</text></svg><p>b</p><math>x</math></article>", "a b x"),
        (f"<div class='layout has-sidebar'><article><p>{LONG}</p></article></div>", LONG), (f"<body class='no-comments'><div id='search-results'><main><p>{LONG}</p></main></div>", LONG),
        (f"<div class=sidebar><article><p>{LONG}</p><section id='related-work'><p>So it goes.</p></section></article></div>", f"{LONG} So it goes."),
        (f"<article><p>{LONG}</p></article><div class='comments'><article class='comment'><p>{LONG}</p></article></div>", LONG),
        (f"<div id=menu><a href=1>A</a><a href=2>B</a></div><h1>Title of it</h1><p>{LONG}</p><p>{LONG}</p><p>It ends so.</p><div class=footer>(c) all of it</div>", f"Title of it {LONG} {LONG} It ends so."),
        (f"<article><p>{LONG}</p><div class='share-buttons'>Tell all</div><div class='comment-list'><p>{LONG}</p></div><p style='display:none'>no</p><p>e</p></article>", f"{LONG} e"),
        (f"<ul><li><a>Home</a></li><li><a>About us</a></li></ul><p>{LONG}</p><p>Short end.</p>", f"{LONG} Short end."),
        (f"<div><p>{LONG}</p><p>See <a>one</a> and <a>two things here</a></p><p>{LONG}</p></div>", f"{LONG} See one and two things here {LONG}"),
        (f"<div><a>Back to the front page</a></div><div><a>Next</a></div><article><p>{LONG}</p></article>", LONG), ("<!DOCTYPE html><?xml x?><article>a<!x>b</article>", "ab"), ("<article>a<!x b", "a<!x b"),
        ("<article>x<!-- <p>no</p> -->y<style>p{}</style></article>", "xy"), ("<article><p title='a>b'>q</p>", "q"), ("<article>a&nbsp;\n b<br>c</article>", "a b c"),
    ],
)
def test_main_text_cases(page, text):
    assert html_text.main_text(page, TREE) == text


@pytest.mark.parametrize("page", ["<a " * 99_000, "<" * 99_000, '<a "' * 99_000, "<div>" * 99_000 + "<b>x</b>" * 99_000, "<![CDATA[" * 99_000, "<video>" * 99_000, "<!--" * 99_000, "<p></div>" * 99_000, "<head>" * 99_000, "<!x" * 99_000, "<?" * 99_000])
def test_broken_pages_take_linear_time(page):
    began = time.process_time()
    html_text.main_text(page, TREE)
    assert time.process_time() - began < 20


def test_the_tree_decides_by_words_and_links_of_neighbours():
    used = {html_text.FEATURES[f] for f, *_ in TREE.nodes if f >= 0}
    assert {"link_density", "apart", "in_article", "marked"} < used and used & {"words_before", "words_after", "link_density_before", "link_density_after"}


def test_layouts_left_out_of_the_tree_one_at_a_time():
    """Blocks of an example page by a tree that has not seen it: nearly all are right where elements and classes say what they are, fewer on pages without an article and on those without classes as well."""
    tables = {n: [(*f, y) for page, labels, weight in html_text.variants(n) for f, y in zip(html_text.block_features(html_text.blocks(page)).tolist(), labels) for _ in range(weight)] for n in html_text.PAGES}
    wrong, n = [0, 0, 0], 0
    for name in html_text.PAGES:
        tree = html_text.Tree(tuple(r for other, rows in tables.items() if other != name for r in rows))
        for i, (page, labels, _) in enumerate(html_text.variants(name)):
            wrong[i] += int((tree.predict(html_text.block_features(html_text.blocks(page))) != labels).sum())
        n += len(labels)
    assert wrong[0] < 0.06 * n and wrong[1] < 0.15 * n and wrong[2] < 0.26 * n


@pytest.mark.parametrize("form", ["as it is", "no article", "article last"])
def test_main_text_of_pages_held_out_from_the_tree(form):
    """The driver's pages, none of which the tree has seen, with and without their article element."""
    pages, right, n = duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet' ORDER BY page_id LIMIT 100").fetchall(), 0, 0
    for (page,) in pages:
        article = re.search(r"<article>(.*?)</article>", page, re.S)
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", article[1])).split())
        page = re.sub("</?article>", "", page) if form == "no article" else page.split("<footer>")[0] if form == "article last" else page
        n, right = n + 1, right + (html_text.main_text(page, TREE) == want)
    assert right >= 0.97 * n


def test_page_cases(spark):
    df = spark.createDataFrame([(None, None, None), (1, "u", "<article>x</article>"), (1, "u", "<article>x</article>")], "page_id long, url string, html string").withColumn("text", F.lit("mine"))
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in html_text.extract(df).collect()) == [("1", "x", 1), ("1", "x", 1), ("None", "", 0)]


CHAT = [
    (1, 0, "user", "Hello there.\nHow are you?"), (1, 1, "assistant", "> How are  YOU?\nFine."), (1, 2, "user", ">> how are you?\n> Fine.\n\nGood to hear"), (1, 3, "user", "> never said\nok"),
    (1, 4, "assistant", "> Good to hear\nyes"), (2, 0, "user", "Fine."), (2, 1, "user", None), (2, 2, None, ""), (None, 3, "user", "> x"), (2, None, "user", "> Fine."),
]


def test_quotes_are_linked(spark):
    df = spark.createDataFrame(CHAT, "conv_id long, turn long, role string, text string").withColumn("level", F.lit("mine")).withColumn("runs", F.lit(1))
    out = quote_links.link_quotes(df)
    got = {(r.conv_id, r.turn): r for r in out.collect()}
    assert len(got) == len(CHAT)
    assert (got[1, 1].reply_to, got[1, 1].root_turn, got[1, 1].depth, got[1, 1].clean_text) == (0, 0, 1, "Fine.")
    assert (got[1, 2].reply_to, got[1, 2].quote_depth, got[1, 2].n_quotes, got[1, 2].n_linked, got[1, 2].depth) == (1, 2, 2, 2, 2)
    assert (got[1, 3].reply_to, got[1, 3].root_turn, got[1, 3].clean_text) == (None, 3, "ok")
    assert (got[1, 4].root_turn, got[1, 4].depth) == (0, 3)
    assert got[2, 1].clean_text == "" and got[2, None].reply_to is None and got[None, 3].clean_text == ""
    assert quote_links.link_quotes(df.where("false")).count() == 0
    assert quote_links.chat_format(out).where("turn = 1 AND conv_id = 1").first().formatted == "<|assistant|>\nFine."
    lines = {(r.turn, r.line_no): (r.level, r.line) for r in quote_links.parse_quotes(df.where("conv_id = 1"), ["turn"]).collect()}
    assert lines[2, 0] == (2, "how are you?") and lines[2, 3] == (0, "Good to hear")


def brute_links(rows):
    """(conv, turn) to the turn replied to and the passages linked, by search in the whole words of all earlier turns."""
    flat = lambda x: " ".join(x.lower().split())
    parsed = {}
    for conv, turn, _, text in rows:
        lines = [(len(re.sub("[^>]", "", re.match(r"(?:[ \t]*>)*", x)[0])), re.sub(r"^(?:[ \t]*>)+ ?", "", x)) for x in text.split("\n")]
        kept = [(v, x) for i, (v, x) in enumerate(lines) if not (v == 0 and i + 1 < len(lines) and lines[i + 1][0] > 0 and re.search(r"(?i)\b(wrote|writes|said)\s*:\s*$", x))]
        runs = []
        for v, x in kept:
            if runs and runs[-1][0] == v:
                runs[-1][1].append(x)
            else:
                runs.append((v, [x]))
        parsed[conv, turn] = ([(v, flat("\n".join(x))) for v, x in runs if v > 0], "\n".join("\n".join(x) for v, x in runs if v == 0))
    out = {}
    for (conv, turn), (quotes, _) in parsed.items():
        links = []
        for v, q in quotes:
            said = []
            for (c, t), (_, own) in parsed.items():
                if c == conv and t < turn and q:
                    whole = flat(own) == q or q in map(flat, own.split("\n"))
                    if whole or len(q.split()) >= 3 and f" {q} " in f" {flat(own)} ":
                        said.append(t)
            if said:
                links.append((v, max(said)))
        out[conv, turn] = (next((t for v, t in links if v == 1), None), len(links))
    return out


def quoted_chats(seed=6):
    """Conversations whose messages quote earlier ones: whole, some of their lines, parts of lines, wrapped anew, in several
    levels, said by several; and passages nobody said."""
    import random

    rng, rows, planted = random.Random(seed), [], {}
    for conv in range(8):
        texts = []
        for turn in range(12):
            body = [" ".join(rng.choice("alpha beta gamma delta eps zeta eta theta".split()) + str(rng.randrange(40)) for _ in range(rng.randint(1, 14))) for _ in range(rng.randint(1, 5))]
            if rng.random() < 0.2:
                body.append("the same stock phrase as ever")
            quote = []
            if turn and rng.random() < 0.8:
                of = rng.randrange(turn)
                words = " ".join(texts[of]).split()
                kind = rng.randrange(4)
                if kind == 0:
                    quote = list(texts[of])
                elif kind == 1:
                    k = rng.randrange(len(texts[of]))
                    quote = texts[of][k : k + rng.randint(1, 3)]
                elif kind == 2 and len(words) > 3:
                    k = rng.randrange(len(words) - 3)
                    quote = [" ".join(words[k : k + rng.randint(3, 20)])]
                else:
                    quote = [" ".join(words[k : k + 4]) for k in range(0, len(words), 4)]
                planted[conv, turn] = of
                quote = ["On Monday they wrote:", *[f"> {x.upper()}" for x in quote]]
                if rng.random() < 0.4:
                    quote += ["> > " + rng.choice(texts[rng.randrange(turn)]), ">> nobody said this"]
            texts.append(body)
            rows.append((conv, turn, "user", "\n".join([*quote, *body])))
    return rows, planted


def test_quote_links_equal_brute_force(spark):
    rows, planted = quoted_chats()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): (r.reply_to, r.n_linked) for r in quote_links.link_quotes(df).collect()}
    assert got == brute_links(rows)
    found = [got[k][0] is not None and got[k][0] >= of for k, of in planted.items()]
    assert len(found) > 50 and sum(found) >= 0.95 * len(found)
    assert all("wrote:" not in r.clean_text for r in quote_links.link_quotes(df).collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    same(quote_links.link_quotes(df), con, quote_links.ORACLE)


def test_parts_of_messages_are_linked(spark):
    first = "First line one\nsecond line one\n\nOther paragraph here"
    rows = [(1, 0, "u", first), (1, 1, "v", "> First line one\n> second line one\nyes"), (1, 2, "v", "> second line one\n> Other paragraph here\nno"), (1, 3, "v", "> line one second line\nso"), (1, 4, "v", "> one\nshort"), (2, 1, "v", "> First line one\nx")]
    got = {(r.conv_id, r.turn): r.reply_to for r in quote_links.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {(1, 0): None, (1, 1): 0, (1, 2): 0, (1, 3): 0, (1, 4): None, (2, 1): None}


def test_long_runs_and_stock_phrases_make_no_pairs(spark):
    rows = [(1, 0, "u", "start here now"), (1, 1, "v", "\n".join(f"> line {i}" for i in range(100_000)))] + [(2, i, "u", "> a stock phrase of all\nA stock phrase of all\n" + str(i)) for i in range(3000)]
    began = time.time()
    out = quote_links.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).where("conv_id = 2").collect()
    assert all(r.reply_to == (r.turn - 1 if r.turn else None) for r in out) and {r.depth for r in out} == set(range(3000)) and time.time() - began < 120


def test_quote_links_use_no_python(spark, sf_dir):
    plan = QUERIES["op2_quote_links"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(0, 60)]
    star = [(1000, 1000 + i) for i in range(1, 50)]
    out = {r.node: r.component for r in shared.components(spark.createDataFrame(chain + star, "a long, b long")).collect()}
    assert {out[i] for i in range(61)} == {0} and {out[1000 + i] for i in range(50)} == {1000} and len(out) == 111
    assert shared.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n = docs.count()
    kept = shared.stored(corpus_pipeline.identify_language(spark, docs, sf_dir), "a")
    assert kept.count() >= 0.98 * n and kept.columns == docs.columns
    deduped = shared.stored(corpus_pipeline.dedup_lines(spark, kept, sf_dir), "b")
    near = shared.stored(corpus_pipeline.dedup_near(spark, deduped, sf_dir), "c")
    rows = deduped.collect()
    assert near.columns == docs.columns and near.count() <= len(rows)
    # of equal texts one is left, that with the smallest id
    first = {}
    for r in sorted(rows, key=lambda r: r.doc_id):
        first.setdefault(r.text, r.doc_id)
    left = [(r.text, r.doc_id) for r in near.collect()]
    assert len({t for t, _ in left}) == len(left) and all(first[t] == i for t, i in left)
    packed = corpus_pipeline.pack(spark, near, sf_dir)
    assert packed.agg(F.countDistinct("doc_id")).first()[0] == near.count()
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_pipeline_on_odd_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "12 34", "en", "s", 5), (4, "the cat sat on the mat and the dog", "en", "s", 34), (4, "the cat sat on the mat and the dog", "en", "s", 34), (None, "der Hund und die Katze", "de", "s", 22)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.identify_language(spark, docs, "")
    assert {r.doc_id for r in out.collect()} <= {4, None}
    for stage in (corpus_pipeline.dedup_lines, corpus_pipeline.dedup_near):
        out = shared.stored(stage(spark, out, ""), "odd")
    assert corpus_pipeline.pack(spark, out, "").count() == out.count()
    none = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, "").count() == 0
    assert packing.place(spark.createDataFrame([], "doc_id long, piece int, length long")).count() == 0
