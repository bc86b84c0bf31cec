"""Classifier, rules, mixing, counts, sharding, byte-level BPE and pages."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from strideframe.llm import bpe, html_extract, mixing, quality_classifier, quality_rules, sharding, token_counts
from strideframe.llm.queries import vocabulary

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = ["", None, " \n\t", "a", "word " * 30_000, "é" * 500, "x\ny\nx\n\nx", "日本語 テスト 🎉", "a" * 5000]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"src{i or 0}", 0) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def coder():
    return bpe.Coder(vocabulary())


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


def test_bpe_is_that_of_the_library(spark, coder, real):
    import tiktoken

    v = vocabulary()
    own = tiktoken.Encoding("own", pat_str=v.pattern, mergeable_ranks=v.ranks, special_tokens={})
    rows = [(i, t) for i, t in enumerate(ODD + [r.text for r in real.limit(150).collect()])] + [(None, "x"), (0, "")]
    out = Counter(tuple(r) for r in bpe.token_digests(docs(spark, rows), v).collect())
    want = Counter()
    for i, t in rows:
        ids = own.encode_ordinary(t or "")
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert out == want
    assert bpe.token_digests(docs(spark, []), v).count() == 0


def test_bpe_round_trip_and_extra_columns(spark):
    rows = list(enumerate(ODD))
    v = vocabulary()
    back = {r.doc_id: bytes(r.bytes) for r in bpe.decode(bpe.encode(docs(spark, rows), v), v).collect()}
    assert back == {i: (t or "").encode() for i, t in rows}
    clash = docs(spark, rows).selectExpr("*", "1 as n_tokens", "2 as IDS", "3 as _coded", "4 as other")
    out = bpe.encode_rows(clash, v)
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "_coded", "other", "n_tokens", "ids", "decoded_sha256"]
    assert {r.doc_id: (r.n_tokens, r._coded, r.other) for r in out.collect()}[3] == (1, 3, 4)


def test_large_ids_stay_exact_beside_nulls(spark, labels):
    ids = [2**53 + 1, None, -(2**63), 2**63 - 1]
    rows = docs(spark, [(i, "some words here") for i in ids]).coalesce(1)
    v = vocabulary()
    for out in (bpe.token_digests(rows, v), bpe.encode(rows, v), bpe.decode(bpe.encode(rows, v), v), token_counts.edited_counts(token_counts.sample_edits(rows), v), quality_classifier.classify(rows, labels), sharding.shard_documents(rows), quality_rules.quality_rules(rows, labels)):
        assert {r.doc_id for r in out.select("doc_id").collect()} == set(ids)


def test_long_pretokens_are_not_remembered(coder):
    texts = ["".join(random.Random(k).choices("abcdefgh", k=10_000)) + " and short ones" for k in range(30)]
    fresh_coder = bpe.Coder(vocabulary())
    for t in [*texts, texts[0]]:
        ids = fresh_coder.encode(t)
        n, ids_sha, decoded_sha = fresh_coder.digest(t)
        assert n == len(ids) and ids_sha == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and decoded_sha == hashlib.sha256(t.encode()).hexdigest()
        assert fresh_coder.decode(ids) == t.encode()
    for memory in (fresh_coder.known, fresh_coder.older, fresh_coder.lists):
        assert all(len(p) <= bpe.SHORT for p in memory) and len(memory) < 10


def test_workers_collect_garbage_again():
    import gc

    from strideframe.llm import runtime

    with pytest.raises(ValueError), runtime.without_gc():
        assert not gc.isenabled()
        raise ValueError
    assert gc.isenabled()


def test_edits_count_like_a_new_encoding(coder):
    rng, counter = random.Random(5), token_counts.Counter(vocabulary())
    for text in ["", "a", "Words and  more words, don't stop 123 " * 40, "x" * 900, "é ü\n\n" * 80]:
        tree = token_counts.Tree(text, counter)
        for _ in range(25):
            n = len(tree.text)
            tree.edit(rng.randint(-2, n + 3), rng.choice([0, 1, 2, 9, 60, n]), rng.choice(["", " ", "'s", "  x\n", "ab cd " * 90, "7"]))
            assert tree.total == len(coder.encode(tree.text)) and tree.chars[1] == len(tree.text)


@pytest.mark.parametrize("leaf", [1, 2, token_counts.LEAF])
def test_edits_beside_blanks_and_apostrophes_count_like_a_new_encoding(coder, leaf):
    counter = token_counts.Counter(vocabulary())
    fill = "a " * 14
    for text in ["end.\n\n", "a  b", "it'r", "x'l y'v  ", "a \n\t \n b", "é\u3000\u00a0\u2028", fill + "it'r", fill + "b.\n\n", fill + "b  c"]:
        for position in range(len(text) + 1):
            for deleted in (0, 1, 2):
                for inserted in ("", " revised", "e", "l", "\n", " ", "'", "'re"):
                    tree = token_counts.Tree(text, counter, leaf)
                    for _ in range(2):  # the second edit meets leaves that the first left
                        tree.edit(position, deleted, inserted)
                        assert tree.total == len(coder.encode(tree.text)), (text, position, deleted, inserted)


def test_an_edit_encodes_a_small_part(spark):
    text = "alpha beta gamma delta " * 3000
    tree = token_counts.Tree(text, token_counts.Counter(vocabulary()))
    before = tree.encoded
    tree.edit(30_000, 4, "omega")
    assert tree.encoded - before < 100 < before


def test_edited_counts_of_odd_rows(spark, coder):
    frame = token_counts.sample_edits(docs(spark, [*enumerate(ODD), (None, "b c d")])).selectExpr("*", "1 as n_edits", "2 as n_leaves")
    for r in token_counts.edited_counts(frame, vocabulary()).collect():
        text = (ODD[r.doc_id] if r.doc_id is not None else "b c d") or ""
        assert r.n_tokens == len(coder.encode(text)) and r.n_edits == 3
    none = spark.createDataFrame([(1, "abc", None), (2, None, [None])], f"doc_id long, text string, edits {token_counts.EDITS}")
    assert sorted(tuple(r)[:5] for r in token_counts.edited_counts(none, vocabulary()).collect()) == [(1, (n := len(coder.encode("abc"))), 0, 3, n), (2, 0, 0, 0, 0)]


def word_counts(text):
    """The base statistics by their definition."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, marks = len(words), Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {j for i in range(n - 2) if marks[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_rule_statistics_match_their_definition(spark, real):
    rows = [*enumerate(ODD), (90, "a b c a b c"), (91, "#*$ %&| <>  x"), (92, "l\nl \nl\n \n"), (None, "q"), (90, "a b c a b c")] + [(100 + r.doc_id, r.text) for r in real.limit(120).collect()]
    stats = quality_rules.statistics(docs(spark, rows).selectExpr("*", "1 as w", "2 as t")).collect()
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in stats)
    assert got == Counter((i, *word_counts(t)) for i, t in rows)


def test_base_statistics_equal_their_sql(spark):
    con = duckdb.connect()
    con.execute("create view documents as select * from read_parquet('/root/testdata/sf0.001/documents.parquet') union all by name select null as doc_id, null as text union all by name select -1 as doc_id, E'é x\ty\nx\n \nx é x y z é x\n' as text")
    cur = con.execute(quality_rules.base_oracle())
    names = [c[0] for c in cur.description]
    small = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(None, None), (-1, "é x\ty\nx\n \nx é x y z é x\n")], "doc_id long, text string"))
    got = Counter(tuple(r) for r in quality_rules.base(quality_rules.statistics(small)).select(*names).collect())
    assert got == Counter(cur.fetchall())


def test_learned_rules_keep_the_good(spark, real, labels):
    out = quality_rules.quality_rules(real, labels).join(labels.where("crc32(cast(doc_id as string)) % 4 = 2"), "doc_id").where("not base_failed").collect()
    wrong = sum(r.kept != (r.quality == 1) for r in out)
    assert len(out) > 50 and wrong <= 0.05 * len(out)
    every = quality_rules.quality_rules(real, labels).select("kept", "base_failed", "n_words", "n_repeat_words").collect()
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.kept and r.base_failed) for r in every)


def test_rules_without_labels_or_rows(spark, labels):
    rows = docs(spark, list(enumerate(["good words here " * 1, " ".join(map(str, range(80)))])))
    out = {r.doc_id: r.kept for r in quality_rules.quality_rules(rows, labels.limit(0)).collect()}
    assert out == {0: False, 1: True}
    assert quality_rules.quality_rules(docs(spark, []), labels).count() == 0


def test_classifier_on_held_out_rows(spark, real, labels):
    found = quality_classifier.classify(real, labels)
    out = found.join(labels, "doc_id").where("held_out").collect()
    assert len(out) > 60
    good, bad = ([r.score for r in out if r.quality == q] for q in (1, 0))
    assert np.mean(np.array(good) >= 0.7) >= 0.97 and np.mean(np.array(bad) < 0.7) >= 0.9
    for r in found.limit(200).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)


def test_classifier_on_odd_tables(spark, labels):
    rows = docs(spark, [*enumerate(ODD), (None, "x"), (0, "")]).selectExpr("*", "1 as stats", "2 as y", "3 as score")
    assert len(quality_classifier.classify(rows, labels).collect()) == len(ODD) + 2
    assert {r.score for r in quality_classifier.classify(rows, labels.limit(0)).collect()} == {1.0}
    for kind in (0, 1):  # labels of one kind: every score is that label
        one = spark.createDataFrame([(0, kind, 0), (1, kind, 0), (3, kind, 0)], "doc_id long, quality int, toxic int")
        assert {(r.score, r.predicted) for r in quality_classifier.classify(rows, one).collect()} == {(float(kind), kind)}
    assert quality_classifier.classify(docs(spark, []), labels).count() == 0
    odd = spark.createDataFrame([(0, 1, 0), (0, 0, 0), (None, 1, 0), (3, None, 0), (4, 0, 1), (5, 1, 1)], "doc_id long, quality int, toxic int")
    assert quality_classifier.classify(rows, odd).count() == len(ODD) + 2


def test_classifier_equals_plain_numpy(spark, real, labels):
    """Statistics, ridge on all labelled rows, calibration by weights of the other fold: the same numbers as on one machine."""
    q, marks = quality_classifier, {r.doc_id: r.quality for r in labels.where("quality in (0, 1)").collect()}
    texts = {r.doc_id: r.text for r in real.collect()}
    crc = {i: zlib.crc32(str(i).encode()) for i in texts}
    train = [i for i in sorted(texts) if i in marks and crc[i] % 4 != 2]
    x, y = np.array([q.statistics(texts[i]) for i in train]), np.array([float(marks[i]) for i in train])
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    rng = np.random.default_rng(q.SEED)
    directions, phases = rng.normal(size=(len(q.NAMES), q.WIDTH)) / np.sqrt(len(q.NAMES)), rng.uniform(0, 2 * np.pi, q.WIDTH)
    lifted = lambda v: np.hstack([np.cos(np.clip((v - mean) / scale, -8, 8) @ directions + phases) * np.sqrt(2 / q.WIDTH), np.ones((len(v), 1))])
    penalty = np.diag([q.RIDGE] * q.WIDTH + [1e-9])
    ridge = lambda a, b: np.linalg.solve(a.T @ a + penalty, a.T @ b)
    fold = np.array([crc[i] // 4 % q.FOLDS for i in train])
    raw = np.zeros(len(train))
    for k in range(q.FOLDS):
        raw[fold == k] = lifted(x[fold == k]) @ ridge(lifted(x[fold != k]), y[fold != k])
    cell = np.clip((raw + 0.5) * q.GRID / 2, 0, q.GRID - 1).astype(int)
    at = np.unique(cell)
    steps = q.isotonic((at + 0.5) * 2 / q.GRID - 0.5, np.array([y[cell == c].sum() for c in at]), np.array([float((cell == c).sum()) for c in at]))
    ids = sorted(texts)
    want = dict(zip(ids, np.clip(np.interp(lifted(np.array([q.statistics(texts[i]) for i in ids])) @ ridge(lifted(x), y), *steps), 0, 1), strict=True))
    got = {r.doc_id: r.score for r in q.classify(real, labels).collect()}
    far = [i for i in ids if abs(got[i] - want[i]) > 1e-6]
    assert set(got) == set(want) and len(far) <= 0.01 * len(ids)  # a raw score on the edge of a cell may fall to either side


def test_isotonic_steps_rise():
    at, level = quality_classifier.isotonic(np.arange(6.0), np.array([0, 2, 1, 3, 2, 4.0]), np.full(6, 4.0))
    assert (np.diff(level) > 0).all() and (np.diff(at) > 0).all() and len(at) == 4


def test_mix_equals_its_sql(spark, real):
    con = duckdb.connect()
    con.execute("create view documents as select * from read_parquet('/root/testdata/sf0.01/documents.parquet')")
    for mix in (mixing.Mix(), mixing.Mix(share=1900, seed=3), mixing.Mix(share=50, epochs=1, sources={"src0": 9, "src1": 4})):
        cur = con.execute(mixing.oracle(mix))
        names = [c[0] for c in cur.description]
        want = sorted(tuple(sorted(zip(names, r, strict=True))) for r in cur.fetchall())
        got = sorted(tuple(sorted(r.asDict().items())) for r in mixing.choose(mixing.measured(real), mix).collect())
        assert got == want and got


def test_mix_redistributes_among_siblings_first(spark):
    rows = [(i, "w " * 10, lang, src) for i, (lang, src) in enumerate([("en", "src0")] * 50 + [("en", "src4")] * 5 + [("de", "src0")] * 50 + [("fr", "src1")] * 50)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    mix = mixing.Mix(domains={"d0": 1, "d1": 1}, langs={"en": 1, "de": 1, "fr": 1}, share=500, epochs=1)
    given = {(r.domain, r.lang, r.source): r.given for r in mixing.leaf_budgets(mixing.measured(frame), mix).collect()}
    # 775 tokens: 387 for d0, half of them for en; src4 has but 50, the rest of en's stays in en.
    assert given == {("d0", "en", "src4"): 50, ("d0", "en", "src0"): 143, ("d0", "de", "src0"): 193, ("d1", "fr", "src1"): 387}


def test_mix_on_odd_tables(spark):
    rows = spark.createDataFrame([(1, "a b", None, None, 7), (1, "a b", None, None, 7), (2, None, "en", "s", 7), (None, "x y", "en", "s", 7), (3, "", "en", "s", 7), (4, "c d e", "en", "srcX", 7)], "doc_id long, text string, lang string, source string, tokens long")
    clash = mixing.mix_sources(rows.selectExpr("*", "1 as _lang", "2 as _source", "3 as copies", "4 as place"), mixing.Mix(share=1000, epochs=1))
    assert {(r._lang, r._source, r.copies, r.place) for r in clash.collect()} == {(1, 2, 3, 4)}
    out = mixing.mix_sources(rows, mixing.Mix(share=1000, epochs=1))
    assert sorted((r.doc_id, r.tokens) for r in out.collect()) == [(1, 2), (1, 2), (4, 3)]
    assert mixing.mix_sources(rows.limit(0)).count() == 0


def test_shards_move_into_the_new_one_only(spark):
    rows = [(i, f"text {i % 7}") for i in range(6000)] + [(None, None), (5, "text 5"), (-3, "é")]
    out = sharding.shard_documents(docs(spark, rows).selectExpr("*", "1 as shard", "2 as slice", "3 as key")).collect()
    assert len(out) == len(rows) and {r.law for r in out} == {"key"}
    assert all(r.grown_shard in (r.shard, 24) for r in out)
    moved = sum(r.grown_shard == 24 for r in out)
    assert 0.5 * len(rows) / 25 < moved < 1.6 * len(rows) / 25
    by = {}
    for r in out:
        by.setdefault(r.shard, []).append(r.slot)
    assert set(by) == set(range(24)) and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) < 1.4 * len(rows) / 24
    one = next(r for r in out if r.doc_id == -3)
    assert (one.size, one.text_crc32) == (10, zlib.crc32("é".encode()))
    assert sharding.shard_documents(docs(spark, [])).count() == 0


def test_shards_equal_their_sql(spark, real):
    con = duckdb.connect()
    con.execute("create view documents as select * from read_parquet('/root/testdata/sf0.001/documents.parquet')")
    small = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    cur = con.execute(sharding.oracle())
    names = [c[0] for c in cur.description]
    want = sorted(cur.fetchall())
    for slice_rows in (sharding.SLICE_ROWS, 3):
        assert sorted(tuple(r) for r in sharding.shard_documents(small, slice_rows=slice_rows).select(*names).collect()) == want
    assert len(want) == small.count()


def test_weights_draw_in_proportion(spark):
    tree = sharding.Tree(((((0, 1.0), (1, 3.0)),), (((2, 4.0),),)))
    out = sharding.with_shard(spark.range(8000).selectExpr("cast(id as string) as k"), "k", tree, "s").groupBy("s").count().collect()
    share = {r.s: r["count"] / 8000 for r in out}
    assert abs(share[0] - 0.125) < 0.02 and abs(share[1] - 0.375) < 0.03 and abs(share[2] - 0.5) < 0.03


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></ul></nav>
<div id="cookie-notice">We use cookies</div><div class="content"><h2>Title &amp; more&nbsp;here</h2><p>One<br>two <b>three</b> <span class="ad">BUY</span><p>Four &lt;five&gt;<ul><li>a<li>b</ul></div>
<aside>Side</aside><section id="comments"><p>first!</p></section><form><p>f</p></form><!-- gone --><footer>&copy; X</footer></body>"""


def test_page_parts_by_name():
    assert html_extract.extract(PAGE) == "Title & more here\n\nOne two three\n\nFour <five>\n\na\n\nb"
    assert html_extract.extract(None) == html_extract.extract("<p>") == html_extract.extract("<script>x") == ""
    assert html_extract.extract("just text") == "just text"
    assert html_extract.extract("<article><h1>A</h1><p>b<div class='comments'><p>c</div></article><div><p>out</div>") == "A\n\nb"
    assert html_extract.extract("<div>" * 3000 + "deep") == "deep"


CARDS = "".join(f"<article class='card'><a href='/{i}'>Teaser {i}</a></article>" for i in range(3))


def test_teaser_cards_and_comment_articles_are_not_the_main_text():
    body = " ".join(f"word{i}" for i in range(30))
    assert body in html_extract.extract(f"<div class='content'><p>{body}</p></div>{CARDS}")
    assert html_extract.extract(f"<div><p>Site</p></div><article><p>{body}</p></article>") == body
    reader = "<article><p>first! I disagree with all of it</p></article>"
    assert html_extract.extract(f"<div class='content'><p>{body}</p></div><section id='comments'>{reader}</section>") == body
    assert html_extract.extract(f"<article><p>{body}</p><section id='comments'>{reader * 9}</section></article>") == body
    assert html_extract.extract(f"<div class='sidebar'><article><p>{body}</p></article></div>") == body


@pytest.mark.parametrize("n", [1, 2, 3, 4, 8])
def test_the_tree_weighs_cards_against_the_body(spark, n):
    body = lambda i: " ".join(f"w{i}n{j}" for j in range(30))
    place = "Welcome to our place " * 20
    plain = [(i, f"http://a.example.org/{i}", f"<div class=content><p>{body(i)}</p></div>{CARDS}") for i in range(n)]
    marked = [(100 + i, f"http://b.example.org/{i}", f"<div class=x1><p>{place}</p></div><article><p>{body(i)}</p></article>") for i in range(n)]
    out = {r.page_id: r.text for r in html_extract.extract_pages(spark.createDataFrame(plain + marked, "page_id long, url string, html string")).collect()}
    sure = 1 / n < html_extract.LOW  # what all n pages repeat has the importance 1 / n
    cards = "" if sure else "".join(f"\n\nTeaser {i}" for i in range(3))
    for i in range(n):
        assert out[i] == body(i) + cards
        assert out[100 + i] == (body(i) if sure else f"{place.strip()}\n\n{body(i)}")


def test_style_tree_finds_unnamed_templates(spark):
    page = lambda i: f"<div class=x1><p>Welcome to our place</p><a href='/about'>About us</a></div><div class=x2><p>{' '.join(f'w{i}n{j}' for j in range(40))}</p></div><div class=x3>All rights are kept</div>"
    rows = [(i, f"https://Host.example.com:80/{i}", page(i)) for i in range(12)] + [(20, "http://lonely.example.org/", page(20)), (21, None, None), (22, "odd", "<p>z"), (0, "https://host.example.com/0", page(0))]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as host", "2 as text", "3 as low")
    out = html_extract.extract_pages(frame).collect()
    by = {r.page_id: r for r in out}
    assert len(out) == len(rows) and by[3].text == " ".join(f"w3n{j}" for j in range(40)) and by[3].n_chars == len(by[3].text)
    assert by[20].text.startswith("Welcome") and (by[21].text, by[21].n_chars) == ("", 0) and by[22].text == "z"
    assert html_extract.extract_pages(frame.limit(0)).count() == 0


BODY = " ".join(f"word{i}" for i in range(30))


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<div class='post has-sidebar'><h1>T</h1><p>b</p></div>", "T\n\nb"),
        ("<div class='no-sidebar layout'><p>b</p></div>", "b"),
        ("<div id='main-content-social'><p>b</p></div>", "b"),
        ("<article class='post tags-politics'><p>b</p></article>", "b"),
        ("<div class='entry-header'><h1>Head</h1></div><p>b", "Head\n\nb"),
        ("<article><div class='article-header'><h1>H</h1></div><p>b</article>", "H\n\nb"),
        ("<article><header><h1>H</h1></header><p>b</article>", "H\n\nb"),
        (f"<form><nav>n</nav><div class='header'>Site</div><p>{BODY}</p><input><footer>f</footer></form>", BODY),
        (f"<div class='layout-sidebar'><div class='menu'>one two</div><div class='post'>{BODY}</div></div>", BODY),
        (f"<div class='sidebar'>{BODY}</div><p>a short article of more than three words</p>", "a short article of more than three words"),
        (f"<article></article><div class='ad'>{BODY}</div><div class=sidebar>{BODY}</div>", ""),
        ("a<![foo[x]]>b<![weird x]>c<![CDATA[d]]>e", "abce"),
        ("<p>x<!-- unterminated <p>y", "x"),
        ("1 < 2 <3 </ x> <a href='y", "1 < 2 <3"),
        ("<script>var a='</p>';", ""),
        ("<p>1<p hidden>2</p><table><tr><td>a<td>b<tr><td>c</table>", "1\n\na\n\nb\n\nc"),
    ],
)
def test_a_name_alone_takes_no_article(page, want):
    assert html_extract.extract(page) == want


BODY = "<p>The long body of the article has many words that say a lot about its topic and go on for a while here.</p>"


@pytest.mark.parametrize("part", [
    "<section id='copyright'><h2>Copyright law</h2><p>Authors hold the rights in their works for many years.</p></section>",
    "<div class='social-policy'><p>Social policy shapes welfare in every state.</p></div>",
    "<div id='login'><h2>Log in</h2><p>Open the terminal, type your name and then your password.</p></div>",
    "<section class='related-work'><h2>Related work</h2><p>Others have tried it.</p></section>",
    "<section id='notes-and-comments'><h2>Notes</h2><p>These tell more.</p></section>",
])
def test_sections_of_an_article_keep_their_text(part):
    said = re.sub("<[^>]*>", " ", part).split()
    for tag in ("article", "main"):
        assert html_extract.extract(f"<{tag}>{BODY}{part}</{tag}>").split()[-len(said) :] == said


def test_parts_inside_an_article_still_go():
    parts = "<div class='related'><a href=x>One more story to read</a> <a href=y>And another story</a></div><div class='newsletter'>Subscribe to our newsletter for weekly news and offers in your inbox today</div><form><p>Tell us what you think about this article in many words here please</p></form><div id='comments'><p>Nice article, I liked it so very much, thank you all</p></div><div class='share'>Share this</div>"
    assert html_extract.extract(f"<article>{BODY}{parts}</article>") == BODY[3:-4]


def test_what_is_not_seen_ends_no_block():
    page = "<p>hello<script>x</script>world</p><p>a <button>b</button>c <noscript><div>d</div></noscript>e <math><mi>x</mi><mo>=</mo><mn>1</mn></math> f<svg><text>no</text></svg> g<wbr>h</p>one<hr>two"
    assert html_extract.extract(page) == "helloworld\n\na c e x=1 f gh\n\none\n\ntwo"


def test_no_page_breaks_the_parser():
    rng = random.Random(1)
    bits = ["<", "<!", "<![", "<![CDATA[", "]]>", ">", "</", "/", "p", "div", '="', "'", "a", "&", "&#x", "&#55296;", ";", " ", "\n", "<!--", "-->", "<script", "</script>", "<title>", "article", "class=", "\x00", "\ud800", "<?", "-", "é", "<br/>", "<li>", "</li>", "<form>", "hidden"]
    for _ in range(4000):
        page = html_extract.Page("".join(rng.choices(bits, k=rng.randint(1, 30))))
        page.text(), page.nodes()


def test_deep_pages_take_time_in_proportion():
    import time

    for page in ("<div>x" * 30_000, "<span class=header>x" * 30_000, "<font>" * 30_000 + "<p>y" * 30_000, "<!--" * 90_000, '<a ="' * 90_000, "<" * 300_000):
        began = time.perf_counter()
        deep = html_extract.Page(page)
        deep.text(), deep.nodes()
        assert time.perf_counter() - began < 20


def test_the_tree_finds_the_main_text_of_pages_without_names(spark):
    """Real pages without article, nav and footer elements and without telling names; a host's menu, notice and footer are its template."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    template: dict[str, tuple[str, str]] = {}
    rows, want = [], {}
    hosts = Counter(re.search("://([^/]+)", r.url)[1].lower() for r in pages)
    for r in pages:
        host = re.search("://([^/]+)", r.url)[1].lower()
        article = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        top, foot = r.html[r.html.index("<nav>") + 5 : r.html.index("</nav>")], r.html[r.html.index("<footer>") + 8 : r.html.index("</footer>")]
        top, foot = template.setdefault(host, (top, foot))
        rows.append((r.page_id, r.url, f"<html><body><div class=a>{top}</div><div class=b>{article}</div><div class=c>{foot}</div></body></html>"))
        want[r.page_id] = html_extract.extract(f"<div class=b>{article}</div>"), host
    got = {r.page_id: r.text for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    large = [i for i, (_, host) in want.items() if hosts[host] > 8]
    assert len(large) > 20 and all(got[i] == want[i][0] for i in large)
    assert not any(html_extract.extract(html) == want[i][0] for i, _, html in rows)  # no tree: the templates stay


def test_page_ids_beside_nulls_and_bytes_that_are_no_utf8(spark):
    big = 2**53 + 1
    frame = spark.createDataFrame([(big, "u", bytearray(b"<p>a\xff\x00b")), (None, "u", None), (big + 2, None, bytearray(b"<p>c"))], "page_id long, url string, html binary").selectExpr("page_id", "url", "cast(html as string) as html")
    out = {r.page_id: r.text for r in html_extract.extract_pages(frame).collect()}
    assert out == {big: "a\ufffd\x00b", None: "", big + 2: "c"}


def test_pages_give_their_articles(spark):
    import html

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in html_extract.extract_pages(pages).collect()}
    for r in pages.collect():
        article = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        parts = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", s)).split()) for s in re.split(r"</?(?:h1|p)>", article))
        assert got[r.page_id] == "\n\n".join(p for p in parts if p)
