"""SimHash, repeated strings and nearest neighbours against brute force."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import Row

from strideframe.llm import ann, runtime, simhash, suffix_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, extra=""):
    return spark.createDataFrame([(i, t, "en", "src1", len(t or "")) for i, t in rows], DOCS)


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def near_rows():
    rng, rows = random.Random(4), []
    base = [words(rng, 300) for _ in range(12)]
    for b in base:
        rows.append(b)
        for _ in range(6):
            w = b.split()
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = "edit"
            rows.append(" ".join(w))
    rows += ["", None, "  \n", "one", "One", "two words", words(rng, 20_000), rows[0], rows[0]]
    return list(enumerate(rows))


def test_fingerprint_is_that_of_spark_and_the_definition(spark):
    text = "The quick Brown fox ÄÖ jumps"
    w = "the quick brown fox ÄÖ jumps".split()
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(len(w) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert simhash.fingerprint(text) == want
    assert simhash.fingerprint(None) == simhash.fingerprint(" \t") == 0
    got = spark.sql("select xxhash64('the quick brown')").first()[0]
    assert got % 2**64 == h[0]


@pytest.mark.parametrize("hot", [simhash.HOT, 1])
def test_near_duplicates_match_all_pairs(spark, near_rows, hot):
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs(spark, near_rows), hot=hot).collect()}
    assert found == simhash.brute_force(near_rows)


def test_near_duplicates_on_odd_tables(spark):
    assert simhash.near_duplicates(docs(spark, [])).count() == 0
    clash = docs(spark, [(3, "a b c d"), (None, "a b c d"), (3, "a b c d")]).selectExpr("*", "1 as fp", "2 as component_id", "3 as root")
    out = simhash.near_duplicates(clash).collect()
    assert len(out) == 3 and {r.component_id for r in out} == {3}


def test_keep_one_keeps_the_smallest(spark, near_rows):
    kept = simhash.keep_one(docs(spark, near_rows))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    want = {i for i, (_, c) in simhash.brute_force(near_rows).items() if i == c}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)
    repeated = docs(spark, [(1, "x y z"), (1, "x y z"), (None, "x y z")])
    assert [r.doc_id for r in simhash.keep_one(repeated.selectExpr("*", "1 as _fp", "2 as __n", "3 as _uid")).collect()] == [1]
    # One id with two unrelated texts: each group keeps one row, and so do groups without any id.
    rng = random.Random(3)
    p, q, r = (words(rng, 40) for _ in range(3))
    rows = [(1, p), (1, q), (2, p), (3, q), (None, r), (None, r)]
    assert sorted((str(x.doc_id), x.text) for x in simhash.keep_one(docs(spark, rows)).collect()) == sorted([("1", p), ("1", q), ("None", r)])


def test_fingerprints_that_share_all_but_one_block_link_as_they_should(spark):
    """A crowd in one block, chains of three bits and far ones: links by balls and by blocks have the same components as all pairs."""
    rng = random.Random(12)
    base = rng.getrandbits(64)
    fps = {base ^ rng.getrandbits(21) for _ in range(150)} | {base ^ rng.getrandbits(22) << 42 for _ in range(150)}
    for _ in range(120):
        fps.add(rng.choice(sorted(fps)) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))))
    fps = sorted(fps)
    root = {f: f for f in fps}

    def top(f):
        while root[f] != f:
            f = root[f]
        return f

    for n, a in enumerate(fps):
        for b in fps[:n]:
            if (a ^ b).bit_count() <= 3:
                x, y = sorted((top(a), top(b)))
                root[y] = x
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    want = sorted(sorted(signed(f) for f in fps if top(f) == t) for t in {top(f) for f in fps})
    frame = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    for hot in (2, simhash.HOT, 10_000):
        scratch = runtime.Scratch(spark)
        links = scratch.put(simhash.fingerprint_links(frame, scratch, hot), "links")
        assert all((r.a ^ r.b).bit_count() <= 3 or ((r.a ^ r.b) % 2**64).bit_count() <= 3 for r in links.collect())
        groups = {}
        for r in runtime.connected_components(links, scratch).collect():
            groups.setdefault(r.component, []).append(r.node)
        linked = {f for g in groups.values() for f in g}
        assert sorted(map(sorted, [*groups.values(), *([signed(f)] for f in fps if signed(f) not in linked)])) == want


def test_a_cluster_must_name_its_shared_folder():
    from types import SimpleNamespace

    nothing = SimpleNamespace(get=lambda *_: None)
    on = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None, set=lambda *_: None), sparkContext=SimpleNamespace(getConf=lambda: nothing, master=master))
    for master in ("spark://host:7077", "yarn", "k8s://x", "local-cluster[2,1,512]"):
        with pytest.raises(ValueError):
            runtime.shared_dir(on(master))
    assert runtime.shared_dir(on("local[4]")).startswith("file:///tmp/spark-")


def test_scratch_tables_go_when_told(spark, tmp_path):
    import os

    scratch = runtime.Scratch(spark)
    scratch.put(spark.range(3), "t")
    at = scratch.base.removeprefix("file://")
    assert os.listdir(at)
    scratch.clear()
    assert not os.path.exists(at)


def test_components_of_long_chains_and_loops(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3), (200, 150)]
    found = {r.node: r.component for r in runtime.connected_components(spark.createDataFrame(links, "a long, b long"), runtime.Scratch(spark)).collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 200: 150, 150: 150}


@pytest.fixture(scope="module")
def string_rows():
    rng = random.Random(9)
    passage, long = words(rng, 80), words(rng, 3000)
    rows = [words(rng, 60) + " " + passage + " " + words(rng, 40) for _ in range(9)]
    rows += [passage, passage, passage[:199], "", None, "ab" * 400, "x" * 199, "x" * 201, long, long[500:3000], "é" * 150 + passage[:230], words(rng, 50) + long[40:260] + long[40:260]]
    return list(enumerate(rows))


@pytest.mark.parametrize("crowd", [suffix_dedup.CROWD, 2])
def test_removal_matches_every_window(spark, string_rows, crowd):
    found = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.removal_digests(docs(spark, string_rows), crowd=crowd).collect()}
    assert found == suffix_dedup.brute_force(string_rows)


@pytest.mark.parametrize("crowd", [suffix_dedup.CROWD, 2])
def test_keeping_the_first_leaves_each_string_once(spark, crowd):
    rng = random.Random(2)
    passage = words(rng, 90)
    rows = [(i, f"{words(rng, 30)} {passage} {words(rng, 30)}") for i in range(6)] + [(9, ""), (10, passage), (11, "clean " + words(rng, 50))]
    out = {r.doc_id: r for r in suffix_dedup.remove_copies(docs(spark, rows), crowd=crowd).collect()}
    assert out[0].text == rows[0][1] and out[11].text == rows[8][1] and out[9].text == ""
    assert 10 not in out and all(passage not in out[i].text for i in range(1, 6))
    windows = [r.text[p : p + 200] for r in out.values() for p in range(len(r.text) - 199)]
    assert len(windows) == len(set(windows))
    assert all(r.n_chars == len(r.text) for r in out.values())


@pytest.mark.parametrize("crowd", [suffix_dedup.CROWD, 2])
def test_rows_that_repeat_keep_their_first_copies(spark, crowd):
    rng = random.Random(6)
    passage, own = words(rng, 90), [words(rng, 60) for _ in range(8)]
    twice = f"{own[0]} {passage} {own[1]} {passage} {own[2]}"
    rows = [(4, twice), (5, "ab" * 400 + own[3]), (None, f"{own[4]} {own[5]}"), (None, f"{own[6]} {own[5]} {own[7]}"), (8, f"{own[7]} {passage}")]
    out = [tuple(r) for r in suffix_dedup.remove_copies(docs(spark, rows + rows[:4]), crowd=crowd).select("doc_id", "text").collect()]
    once = [tuple(r) for r in suffix_dedup.remove_copies(docs(spark, rows), crowd=crowd).select("doc_id", "text").collect()]
    assert sorted(out, key=str) == sorted(once + [r for r in once if r[0] != 8], key=str)
    assert all(any(part in t for _, t in out) for part in (passage, *own))


def test_removal_on_odd_tables(spark):
    assert suffix_dedup.removal_digests(docs(spark, [])).count() == 0
    same = docs(spark, [(1, "q" + "w e r t " * 60), (1, "q" + "w e r t " * 60), (None, None)]).selectExpr("*", "1 as did", "'z' as body", "2 as list")
    out = suffix_dedup.removal_digests(same).collect()
    assert sorted((r.n_bytes, r.n_removed) for r in out) == [(0, 0), (481, 481), (481, 481)]


def test_longest_previous_factors_of_a_word():
    text = b"abracadabra"
    order = sorted(range(11), key=lambda i: text[i:])
    common = [0] + [next((k for k in range(11) if text[a : a + k + 1] != text[b : b + k + 1] or max(a, b) + k >= 11), 0) for a, b in zip(order, order[1:], strict=False)]
    got = suffix_dedup.longest_previous(np.array(order), np.array(common)).tolist()
    want = [max((k for k in range(12 - i) if any(text[j : j + k] == text[i : i + k] for j in range(i))), default=0) if i else 0 for i in range(11)]
    assert got == want


@pytest.mark.parametrize("length", [1, 8, 20, 200])
def test_suffix_order_and_factors_are_those_of_the_definition(length):
    rng = random.Random(length)
    for turn in range(40):
        blocks = [bytes(rng.choices(b"ab" if turn % 2 else b"abcd\0\xff", k=rng.randint(length, length + 60))) for _ in range(rng.randint(1, 5))]
        blocks += [blocks[0]] * (turn % 3)
        text, ends = b"".join(blocks), np.cumsum([len(b) for b in blocks])
        starts = np.concatenate([np.arange(e - len(b), e - length + 1) for b, e in zip(blocks, ends, strict=True)])
        heads = [text[s : s + length] for s in starts]
        order, common = suffix_dedup.suffix_order(np.frombuffer(text, np.uint8), starts, length)
        want = sorted(range(len(heads)), key=lambda i: (heads[i], i))
        shared = lambda a, b: next((k for k in range(length) if a[k] != b[k]), length)
        assert order.tolist() == want and common.tolist() == [0, *(shared(heads[a], heads[b]) for a, b in zip(want, want[1:], strict=False))]
        factors = [max((shared(heads[j], heads[i]) for j in range(i)), default=0) for i in range(len(heads))]
        assert suffix_dedup.longest_previous(order, common).tolist() == factors
        earlier, other = (np.concatenate(x).tolist() for x in suffix_dedup.repeats(blocks, length))
        assert earlier == [h in heads[:i] for i, h in enumerate(heads)] and other == [heads.count(h) > 1 for h in heads]


def test_removal_keeps_ids_as_they_are(spark):
    rng = random.Random(5)
    ids = [-(1 << 63), None, 2**53 + 1, None, 0]
    rows = [(i, words(rng, 60)) for i in ids]
    shared = words(rng, 60)
    out = suffix_dedup.removal_digests(docs(spark, rows + [(7, shared), (None, shared)])).collect()
    assert Counter((r.doc_id, r.n_removed > 0) for r in out) == Counter([*((i, False) for i in ids), (7, True), (None, True)])
    kept = suffix_dedup.remove_copies(docs(spark, rows + [(None, shared), (None, "a " + shared)])).collect()
    # The copy that a hash puts first stays; the other goes altogether or down to what is its own.
    assert not Counter(ids) - Counter(r.doc_id for r in kept) and sum(shared in r.text for r in kept) == 1


def test_nearest_reach_the_recall(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(1500, 64)).astype(np.float32)
    vectors[100:160] = vectors[99]  # one vector that many rows share
    rows = [Row(vec_id=i, embedding=v.tolist(), label=0) for i, v in enumerate(vectors)]
    out = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    truth = ann.brute_force(range(1500), vectors.astype(float))
    got = {}
    for r in sorted(out, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == set(truth) and all(len(v) == 5 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in truth[q]}) for q in truth)
    assert hits >= 0.9 * 5 * len(truth)
    assert [i for i, _ in got[100]] == [99, 101, 102, 103, 104]
    assert all(abs(dict(truth[q])[i] - s) < 1e-12 for q in truth for i, s in got[q] if i in dict(truth[q]))


def test_nearest_in_narrow_windows_of_many_vectors(spark):
    """Half of the vectors are random directions, the worst case for any curve, half lie in clusters; codes choose 64 of 20,000 for the exact measure."""
    rng = np.random.default_rng(8)
    n = 20_000
    centres = rng.normal(size=(200, 64))
    vectors = np.where(np.arange(n)[:, None] % 2 == 0, rng.normal(size=(n, 64)), centres[np.arange(n) % 199] + 0.6 * rng.normal(size=(n, 64))).astype(np.float32)
    ids = rng.permutation(n)
    frame = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, vectors, strict=True)], "vec_id long, embedding array<float>")
    truth = ann.brute_force(ids, vectors.astype(float))
    got = {}
    for r in ann.search(frame).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert set(got) == set(truth)
    assert sum(len(got[q] & {i for i, _ in truth[q]}) for q in truth) >= 0.93 * 5 * len(truth)


@pytest.mark.parametrize("rows", [3, 100, 700])
def test_windows_are_the_places_around_each_query(spark, monkeypatch, rows):
    monkeypatch.setattr(ann, "RANGE", 40)  # the buffer is cut often
    rng = np.random.default_rng(rows)
    codes = ann.coded(ann.unit(rng.normal(size=(rows, 7))))
    asked = rng.random(rows) < 0.3
    part = np.sort(rng.integers(0, 2, rows))
    frame = spark.createDataFrame([(int(p), k, k, bytes([int(a)]) + c.tobytes()) for k, (p, a, c) in enumerate(zip(part, asked, codes, strict=True))], "part int, key long, rep long, code binary").coalesce(1)
    got = {(r.query, r.rep) for r in ann.windows(frame, 9, 99).collect()}
    assert got == {(q, x) for q in range(rows) if asked[q] for x in range(q - 9, q + 10) if 0 <= x < rows and x != q and part[x] == part[q]}


def test_nearest_of_several_lengths(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=(3, 5, 64)[i % 3]).tolist()) for i in range(600)] + [(1000, [1.0, 2.0])]
    got = {}
    for r in sorted(ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r.vec_id)
    for m in range(3):
        ids = [i for i in range(600) if i % 3 == m]
        truth = ann.brute_force(ids, np.array([rows[i][1] for i in ids]))
        assert all(got[q] == [i for i, _ in near] for q, near in truth.items())
    assert 1000 not in got


def test_cosines_of_very_large_and_very_small_vectors(spark):
    rows = [(0, [1e200, 1e200]), (1, [1.0, 0.5]), (2, [1e-200, 2e-200]), (3, [-1e308, 1e308]), (4, [5e-324, 0.0]), (5, [0.25, 0.25])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r.score for r in ann.search(d, is_query="vec_id = 0").collect()}
    want = {1: 1.5 / np.sqrt(2.5), 2: 3 / np.sqrt(10), 3: 0.0, 4: 1 / np.sqrt(2), 5: 1.0}
    assert got.keys() == want.keys() and all(abs(got[i] - w) < 1e-12 for i, w in want.items())
    v = np.random.default_rng(0).normal(size=(50, 64))
    assert (ann.scaled(v) / v == (ann.scaled(v) / v)[:, :1]).all()


def test_a_search_without_tops_is_exact(spark):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(400, 24))
    d = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    found = {}
    for r in ann.search(d, curves=1, reach=400, window_top=None, merged_top=None).collect():
        found.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    assert {q: [x[k] for k in sorted(x)] for q, x in found.items()} == {q: [i for i, _ in x] for q, x in ann.brute_force(range(400), v).items()}


def test_nearest_leaves_unusable_vectors_out(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [float("inf"), 1.0]), (None, [1.0, 1.0]), (50, [0.0, 2.0]), (7, [])]
    out = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as rep", "2 as n")).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in out) == [(0, 1, 1), (0, 2, 50), (50, 1, 1), (50, 2, 0)]
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_hilbert_neighbours_touch():
    cells = np.array([[x, y, z] for x in range(8) for y in range(8) for z in range(8)])
    keys = ann.hilbert_keys(cells, 3)
    assert sorted(keys.tolist()) == list(range(512))
    steps = np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1)
    assert (steps == 1).all()


def test_no_nearest_vector_is_missed_in_a_crowd(spark):
    """Vectors so close together that their codes are alike: only the exact check tells them apart."""
    rng = np.random.default_rng(3)
    v = rng.normal(size=(4, 64))[np.arange(3000) % 4] + 1e-3 * rng.normal(size=(3000, 64))
    d = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    found = defaultdict(dict)
    for r in ann.search(d).collect():
        found[r.query_id][r.rank] = r.vec_id
    truth = ann.brute_force(range(3000), v)
    assert {q: [x[n] for n in sorted(x)] for q, x in found.items()} == {q: [i for i, _ in x] for q, x in truth.items()}
