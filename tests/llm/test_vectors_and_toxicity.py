"""Whitening, vector codes and toxic spans against brute force."""

from __future__ import annotations

import hashlib
import itertools
import math

import duckdb
import numpy as np
import pytest

from strideframe.llm import queries, toxicity, vector_codes, whitening
from strideframe.llm.runtime import Scratch, summed

VECTORS = "vec_id long, embedding array<double>, label int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, l) for i, v, l in rows], VECTORS)


ODD = [(1, None, 0), (2, [0.5, None], 1), (3, [math.nan, 1.0], 1), (4, [math.inf, 1.0], None), (5, [], 2)]


# Sums over partitions


def test_sums_over_partitions_have_one_value_whatever_the_partitions(spark):
    rows = spark.range(1000).selectExpr("cast(id as double) / 7 as v")

    def part(batches):
        return np.array([sum(b.num_rows for b in batches)], np.int64)

    assert summed(rows.repartition(40), part).tolist() == [1000]
    assert summed(rows.where("v < 0"), part).tolist() == [0]


# Whitening


def plain_whitening(rows, k=16):
    x = {i: np.floor(64 * np.asarray(v, np.float64)).astype(np.int64) + 1_000_000 for i, v in rows}
    fitted = np.array(sorted({tuple(v) for v in x.values()}), np.int64)
    n, sums = len(fitted), fitted.sum(axis=0)
    centred = (fitted * n - sums) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    trace = (centred**2).sum() / n
    return {i: (n, int(((n * v - sums) ** 2).sum()), ((n * v - sums) / n) @ vectors / np.sqrt(values), values / trace) for i, v in x.items()}


@pytest.mark.parametrize(("size", "n"), [(64, None), (20, 300), (200, 500), (3, 50)])
def test_whitening_equals_a_full_eigendecomposition(spark, sf, size, n):
    if n is None:
        table = queries.table(spark, sf, "embeddings")
        rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    else:
        rng = np.random.default_rng(size)
        rows = [(i, (rng.normal(size=size) * np.linspace(3, 0.5, size)).tolist()) for i in range(n)]
        table = vectors(spark, [(i, v, 0) for i, v in rows])
    want = plain_whitening(rows)
    found: dict[int, dict[int, object]] = {}
    for r in whitening.whiten(table).collect():
        found.setdefault(r["vec_id"], {})[r["component"]] = r
    assert found.keys() == want.keys()
    signs = None
    for i, (n_fit, deviation, white, explained) in want.items():
        k = len(explained)
        got = [found[i][c] for c in range(1, k + 1)]
        assert len(found[i]) == k and {(r["n"], r["deviation"]) for r in got} == {(n_fit, deviation)}
        assert np.allclose([r["explained"] for r in got], explained, rtol=1e-9)
        assert got[0]["identity_error"] < 1e-9
        mine = np.array([r["whitened"] for r in got])
        signs = np.sign(mine * white) if signs is None else signs
        assert np.allclose(mine * signs, white, atol=1e-7)


def test_rounds_end_with_certified_residuals():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 300)) * np.geomspace(5, 1, 300)
    v = x.T @ x / len(x)
    values, components, rounds = whitening.lobpcg(lambda block: v @ block, 300, 16)
    assert np.allclose(values, np.linalg.eigvalsh(v)[::-1][:16], rtol=1e-12)
    assert np.linalg.norm(v @ components - components * values, axis=0).max() < 1e-12 * values[0]
    assert np.allclose(components.T @ components, np.eye(16), atol=1e-13) and 3 < rounds < 60


def test_whitening_of_odd_tables(spark):
    assert whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, ODD)).count() == 0
    clash = vectors(spark, [*ODD, (7, [1.0, 2.0], 0), (None, [2.0, 0.5], 1), (7, [1.0, 2.0], 0), (8, [0.0, -0.0], 3), (9, [1.0, 2.0, 4.0], 3)]).selectExpr("*", "1 as x", "2 as component", "3 as n")
    got = [tuple(r) for r in whitening.whiten(clash).collect()]
    assert sorted((r[0] is None, r[0] or 0, r[1]) for r in got) == [(False, 7, 1), (False, 7, 1), (False, 7, 2), (False, 7, 2), (False, 8, 1), (False, 8, 2), (False, 9, 1), (False, 9, 2), (False, 9, 3), (True, 0, 1), (True, 0, 2)]
    assert {r[2] for r in got if r[0] != 9} == {3} and {(r[2], r[3], r[4], r[5]) for r in got if r[0] == 9} == {(1, 0, None, 0.0)}


def test_deviations_are_exact_or_null(spark):
    rows = [(i, [1e5 * i, -2.0 * i], 0) for i in range(60)]
    got = {r["vec_id"]: r["deviation"] for r in whitening.whiten(vectors(spark, rows)).collect()}
    x = {i: [math.floor(64 * c) + 1_000_000 for c in v] for i, v, _ in rows}
    sums = [sum(v[d] for v in x.values()) for d in range(2)]
    exact = {i: sum((60 * a - s) ** 2 for a, s in zip(v, sums, strict=True)) for i, v in x.items()}
    assert got == {i: d if d < 2**63 else None for i, d in exact.items()}
    assert None in got.values() and len(set(got.values())) > 5
    huge = {r["vec_id"]: r["deviation"] for r in whitening.whiten(vectors(spark, [(1, [1e300, 1.0], 0), (2, [-1e308, 2.0], 0)])).collect()}
    assert huge == {1: None, 2: None}


# Vector codes


def plain_codes(rows):
    kept = sorted((i, [math.floor(4096 * c) for c in v], label) for i, v, label in rows)
    width = len(kept[0][1]) // 8
    part = lambda x, p: x[p * width : (p + 1) * width]
    books = [[part(x, p) for _, x, _ in kept[:16]] for p in range(8)]
    near = lambda v, book: min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(6):
        for p in range(8):
            hits: dict[int, list] = {}
            for _, x, _ in kept:
                hits.setdefault(near(part(x, p), books[p])[1], []).append(part(x, p))
            books[p] = [[sum(c) // len(hits[k]) for c in zip(*hits[k], strict=True)] if k in hits else e for k, e in enumerate(books[p])]
    out = {}
    for i, x, label in kept:
        best = [near(part(x, p), books[p]) for p in range(8)]
        out[i] = ("".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best), label)
    total: dict[object, int] = {}
    for _, error, label in out.values():
        total[label] = total.get(label, 0) + error
    text = ",".join(str(c) for book in books for e in book for c in e)
    return {i: (code, error, total[label], hashlib.sha256(text.encode()).hexdigest()) for i, (code, error, label) in out.items()}


@pytest.mark.parametrize("n", [5, 200])
def test_codes_equal_plain_rounds(spark, n):
    rng = np.random.default_rng(n)
    # Few distinct values: many ties and unused entries.
    rows = [(i * 3, (rng.integers(-2, 3, 16) / 7).tolist(), None if i % 5 == 0 else i % 3) for i in range(n)]
    found = vector_codes.compress(vectors(spark, rows).repartition(5)).collect()
    assert {r["vec_id"]: (r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in found} == plain_codes(rows)


def test_codes_equal_their_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    want = con.execute(f"select vec_id, code, error, label_error, codebooks_sha256 from ({vector_codes.oracle()})").fetchall()
    assert sorted(want) == sorted(tuple(r) for r in queries.op13_vector_codes(spark, sf).collect()) and len(want) > 100


def test_an_annulus_holds_every_nearest_entry_and_few_others():
    rng = np.random.default_rng(1)
    for entries in (rng.integers(-3, 4, (40, 2)), rng.integers(-(2**27), 2**27, (300, 8)), np.zeros((4, 3), np.int64)):
        points = np.vstack([rng.integers(entries.min() - 2, entries.max() + 3, (500, entries.shape[1])), entries])
        far = ((points[:, None] - entries) ** 2).sum(axis=2)
        book = vector_codes.Annuli(entries)
        code, best = book.nearest(points)
        assert (code == far.argmin(axis=1)).all() and (best == far.min(axis=1)).all()
    spread = np.geomspace(10, 1e6, 256).astype(np.int64)[:, None] * np.array([[1, 1]])
    book = vector_codes.Annuli(spread)
    book.nearest(spread + 1)
    assert book.measured < 0.1 * 256 * 256


def test_codes_of_odd_tables(spark):
    assert vector_codes.compress(vectors(spark, [])).count() == 0
    rows = [*ODD, (9, [1.0] * 8, None), (9, [1.0] * 8, None), (None, [0.5] * 8, 3), (10, [1e300] * 8, 3), (11, [0.25] * 5, 3)]
    clash = vectors(spark, rows).selectExpr("*", "1 as x", "2 as code", "3 as of")
    got = sorted(((r["vec_id"] is None, r["vec_id"] or 0), r["code"], r["error"], r["label_error"]) for r in vector_codes.compress(clash).collect())
    assert [(k[1], len(code)) for k, code, _, _ in got] == [(5, 16), (9, 16), (9, 16), (10, 16), (11, 16), (0, 16)]
    assert all(e is not None and e >= 0 for _, _, e, _ in got)


def test_label_errors_of_one_crowded_label(spark):
    rows = vectors(spark, [(i, [i / 50.0] * 8, 1 if i % 3 else i) for i in range(900)])
    found = vector_codes.compress(rows).collect()
    assert {r["label_error"] for r in found if r["vec_id"] % 3} == {sum(r["error"] for r in found if r["vec_id"] % 3 or r["vec_id"] == 1)}
    assert len(found) == 900


# Toxicity


def enumerated(psi, into, out, inside):
    """Marginals, expected transitions and log partition function over all taggings."""
    n, total = len(psi), 0.0
    marginals, pairs = np.zeros(n), np.zeros(3)
    for y in itertools.product((0, 1), repeat=n):
        moves = np.array([sum(a < b for a, b in itertools.pairwise(y)), sum(a > b for a, b in itertools.pairwise(y)), sum(a and b for a, b in itertools.pairwise(y))])
        weight = math.prod(p for p, s in zip(psi, y, strict=True) if s) * into ** moves[0] * out ** moves[1] * inside ** moves[2]
        total += weight
        marginals += weight * np.array(y)
        pairs += weight * moves
    return marginals / total, pairs / total, math.log(total)


def test_forward_backward_equals_all_taggings():
    rng = np.random.default_rng(2)
    psi, live = rng.uniform(0.01, 4, (2, 3, 6)), np.arange(6) < np.array([6, 3, 1])[:, None]
    into, out, inside = rng.uniform(0.2, 3, (3, 2))
    marginals, pairs = toxicity.forward_backward(psi, live, into, out, inside)
    for m, r in itertools.product(range(2), range(3)):
        n = live[r].sum()
        want = enumerated(psi[m, r, :n], into[m], out[m], inside[m])
        assert np.allclose(marginals[m, r, :n], want[0]) and not marginals[m, r, n:].any()
        assert np.allclose(pairs[:, m, r], want[1])


def test_reading_a_text_equals_all_taggings():
    lexicon = toxicity.Lexicon(["=bad", "^wor"])
    field = toxicity.Field(lexicon, np.array([-1.5, -0.7, 0.4, 0.9, 2.0, 1.0]))
    words = "all Bad worse of bad ones".split()
    sig = lexicon.signatures(words)
    assert [lexicon.patterns[s - 1] if s else "" for s in sig] == ["", "=bad", "^wor", "", "=bad", ""]
    into, out, inside = np.exp([-0.7, 0.4, 0.9])
    emission = np.exp(-1.5 + np.array([0.0, 2.0, 1.0]))
    want = enumerated(emission[[{"=bad": 1, "^wor": 2}.get(lexicon.patterns[s - 1], 0) if s else 0 for s in sig]], into, out, inside)
    plain = enumerated(np.full(6, emission[0]), into, out, inside)
    odds, marginals = field.read(words)
    assert np.allclose(marginals, want[0]) and math.isclose(odds, want[2] - plain[2], rel_tol=1e-9)
    assert math.isclose(field.plain(6), plain[2], rel_tol=1e-12) and field.plain(0) == 0 and field.read([]) == (0.0, None)
    long = field.plain(toxicity.SETTLED + 5) - field.plain(toxicity.SETTLED + 4)
    assert math.isclose(long, field.plain(toxicity.SETTLED) - field.plain(toxicity.SETTLED - 1), rel_tol=1e-9)
    assert math.isfinite(field.read(["bad"] * 50_000)[0])


def test_the_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(3)
    cover = toxicity.Lexicon(["=bad", "^bad", "^wor"]).cover()
    sequences, toxic = [rng.integers(0, 4, n) for n in (5, 3, 4)], np.array([True, False, True])
    weights = rng.normal(size=(1, 7))

    def likelihood(w):
        total = 0.0
        for s, t in zip(sequences, toxic, strict=True):
            e = np.exp(cover[s] @ w[4:] + w[0])
            y = (s > 0) & t
            moves = [sum(~y[:-1] & y[1:]), sum(y[:-1] & ~y[1:]), sum(y[:-1] & y[1:])]
            total += np.log(e[y]).sum() + np.dot(moves, w[1:4]) - enumerated(e, *np.exp(w[1:4]))[2]
        return total

    got = toxicity.gradient(weights, cover, sequences, toxic, np.ones((1, 3)))[0]
    for k in range(7):
        d = np.eye(7)[k] * 1e-6
        assert abs((likelihood(weights[0] + d) - likelihood(weights[0] - d)) / 2e-6 - got[k]) < 1e-5


def test_toxic_documents_are_caught_and_clean_ones_left(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["toxic"] for r in queries.table(spark, sf, "labels").collect()}
    rows = queries.op12_toxicity(spark, sf).collect()
    texts = {r["doc_id"]: r["text"] for r in queries.table(spark, sf, "documents").select("doc_id", "text").collect()}
    assert len(rows) == len(texts) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    toxic, clean = [[r["predicted"] for r in held if labels[r["doc_id"]] == y] for y in (1, 0)]
    assert len(held) > 50 and np.mean(toxic) >= 0.75 and np.mean(clean) <= 0.02
    for r in rows:
        for s in r["spans"]:
            assert texts[r["doc_id"]][s["begin"] : s["end"]].strip() and s["marginal"] >= 0.5
    said = {texts[r["doc_id"]][s["begin"] : s["end"]].lower() for r in rows for s in r["spans"]}
    assert {"idiot", "moron", "scum"} <= said


LABELS = "doc_id long, quality int, toxic int"
DOCS = "doc_id long, text string"


def small_corpus():
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(60)]
    rows, labels = [], []
    for i in range(400):
        text = rng.choice(words, 30).tolist()
        toxic = i % 4 == 0
        for _ in range(3 if toxic else 0):
            text.insert(rng.integers(0, 30), rng.choice(["Nasty", "vile"]))
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_spans_and_scores_on_a_small_corpus(spark):
    rows, labels = small_corpus()
    rows += [(900, "w1 NASTY vile w2"), (901, ""), (902, None), (903, "w1 " * 3000 + "vile"), (None, "Vile, nasty."), (900, "w1 NASTY vile w2")]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as score", "2 as y", "'x' as lang", "3 as fold")
    found = toxicity.classify(docs, spark.createDataFrame(labels, LABELS)).collect()
    assert len(found) == len(rows)
    by = {r["doc_id"]: r for r in found}
    assert [(s["begin"], s["end"]) for s in by[900]["spans"]] == [(3, 13)] and by[900]["predicted"] == 1
    assert by[901]["score"] == by[902]["score"] < 0.5 and by[902]["n_words"] == 0 and not by[902]["spans"]
    assert by[None]["predicted"] == 1 and not by[None]["held_out"] and [(s["begin"], s["end"]) for s in by[903]["spans"]] == [(9000, 9004)]
    wrong = [i for i, _, y in labels if by[i]["predicted"] != y]
    assert len(wrong) < 6


def test_toxicity_without_labels_rows_or_kinds(spark):
    rows, labels = small_corpus()
    docs, none = spark.createDataFrame(rows, DOCS), spark.createDataFrame([], LABELS)
    assert {r["score"] for r in toxicity.classify(docs, none).collect()} == {0.0}
    assert {r["score"] for r in toxicity.classify(docs, spark.createDataFrame([(i, 1, 1) for i in range(50)], LABELS)).collect()} == {1.0}
    odd = spark.createDataFrame([(None, 1, 1), (1, None, None), (2, 0, 7)], LABELS)
    assert {r["score"] for r in toxicity.classify(docs, odd).collect()} == {0.0}
    assert toxicity.classify(docs.limit(0), spark.createDataFrame(labels, LABELS)).count() == 0


def test_copies_make_no_pattern_telling(spark):
    rows, labels = small_corpus()
    odd = "".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}q{k}y " for k in range(40))
    rows += [(1000 + i, odd) for i in range(60)]
    labels += [(1000 + i, 1, 1) for i in range(60)]
    y = dict((i, t) for i, _, t in labels)
    train = spark.createDataFrame([(t, y[i]) for i, t in rows], "text string, y int")
    assert {p.lstrip("=^")[:3] for p in toxicity.telling_patterns(train).patterns} == {"nas", "vil"}


def test_the_fit_reads_a_bounded_sample(spark):
    rows, labels = small_corpus()
    scratch = Scratch(spark)
    model = toxicity.fit(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS), scratch, sample=100)
    assert isinstance(model, toxicity.Field)
    train = spark.read.parquet(f"{scratch.base}/1-train")
    assert train.count() <= 100
