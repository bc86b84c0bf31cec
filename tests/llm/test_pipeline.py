"""The pipeline's stages on small tables, and its whole against brute force where that is one."""

from __future__ import annotations

import corpus_pipeline
from strideframe.llm import simhash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_every_stage_works_on_what_the_one_before_kept(spark, tmp_path):
    sf, docs = "/root/testdata/sf0.01", spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    counts = [docs.count()]
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / str(n)))
        docs = spark.read.parquet(str(tmp_path / str(n)))
        counts.append(docs.count())
        if name == "simhash_dedup":
            want = {i for i, (_, c) in simhash.brute_force([(r.doc_id, r.text) for r in before.collect()]).items() if i == c}
            assert {r.doc_id for r in docs.collect()} == want
        if name == "suffix_dedup":
            texts = [r.text for r in docs.collect()]
            windows = [t[p : p + 200] for t in texts for p in range(len(t) - 199)]
            assert len(windows) == len(set(windows))
        if n < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == COLUMNS
    assert counts[0] > counts[1] > counts[2] >= counts[3] > counts[4] == counts[5] > 0
    assert docs.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "decoded_sha256"]
    assert all(r.n_tokens == len(r.ids) for r in docs.collect())


def test_bad_documents_go_and_good_ones_stay(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    kept = {r.doc_id for r in corpus_pipeline.classify(spark, docs, sf).collect()}
    marks = {r.doc_id: r.quality for r in labels.collect()}
    good = [i in kept for i, q in marks.items() if q == 1]
    bad = [i not in kept for i, q in marks.items() if q == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) >= 0.9 * len(bad)


def test_an_empty_corpus_runs(spark, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_odd_documents_pass_through_every_stage(spark, tmp_path):
    """Null ids and texts, repeated rows, a very long text and columns whose names the operators use themselves."""
    import random

    from strideframe.llm import bpe
    from strideframe.llm.queries import vocabulary

    rng = random.Random(7)
    words = lambda n: " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(n))
    shared, twin, own = words(60), words(80), words(50_000)
    rows = [(2**53 + 1, own), (None, twin), (None, twin), (None, None), (3, ""), (4, f"{words(80)} {shared} {words(80)}"), (5, f"{words(80)} {shared} {words(80)}"), (5, f"{words(80)} {shared} {words(80)}"), (4, words(70))]
    rows += [rows[0], rows[5], *((100 + i, words(2000)) for i in range(30))]
    docs = spark.createDataFrame([(i, t, "en", "src1", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.selectExpr("*", "1 as _fp", "2 as _row", "3 as stats", "4 as th", "5 as n", "6 as _coded")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    names = docs.columns
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / str(n)))
        docs = spark.read.parquet(str(tmp_path / str(n)))
        if n < 4:
            assert docs.columns == names
        if n == 1:
            kept = {(r.doc_id, r.text) for r in docs.collect()}
            assert len(kept) == docs.count() == 37 and (None, twin) in kept and (2**53 + 1, own) in kept
        if n == 2:
            texts = [r.text for r in docs.collect()]
            assert sum(shared in (t or "") for t in texts) == 1 and own in texts
    out = {r.doc_id: r for r in docs.collect()}
    assert out and None not in out and 3 not in out
    assert all(len(bpe.Coder(vocabulary()).decode(r.ids)) > 0 for r in out.values())
