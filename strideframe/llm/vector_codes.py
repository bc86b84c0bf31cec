"""Product codes of vectors, nearest entries found by annular norm pruning.

Vectors of whole numbers are cut into equal parts; each part is replaced by the
index of the nearest entry of its codebook. By the triangle inequality an entry
at distance r has a norm within r of the part's own. So the entries are sorted
by norm, the two whose norms are next to the part's give a first distance, two
binary searches give the interval of norms that this distance allows, and all
entries of that annulus, its borders included, are measured exactly in whole
numbers.

Codebooks are means of the parts they attract: every round is one pass over the
table, of which partitions send sums and counts of each entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.llm.runtime import Scratch, matrix, summed

PARTS, ENTRIES, ROUNDS, STEPS = 8, 16, 6, 4096
#: Parts that are compared at a time.
BLOCK = 4096


def whole_vectors(vectors: DataFrame, steps: int = STEPS) -> DataFrame:
    """vec_id, label and x of the vectors without null or non-finite components: floor(steps * component).

    Components of which squares of differences would not fit into a long, summed over the vector, count as the largest that do.
    """
    good = F.expr("embedding is not null and forall(embedding, c -> c is not null and not isnan(c) and abs(c) < double('infinity'))")
    bound = "cast(floor(sqrt(4e18D / greatest(size(embedding), 1)) / 2) as bigint)"
    x = f"transform(cast(embedding as array<double>), c -> cast(greatest(-{bound}, least({bound}, floor({steps}D * c))) as int))"
    return vectors.where(good).select("vec_id", "label", F.expr(x).alias("x"))


def parts_of(x: np.ndarray, parts: int = PARTS) -> np.ndarray:
    """(rows, parts, width): equal consecutive parts; a length that parts do not divide is filled up with zeros."""
    width = max(1, -(-x.shape[1] // parts))
    out = np.zeros((len(x), parts * width), np.int64)
    out[:, : x.shape[1]] = x
    return out.reshape(len(x), parts, width)


class Annuli:
    """A codebook (entries, width) of whole numbers, sorted by norm."""

    def __init__(self, entries: np.ndarray):
        norms = np.sqrt((entries.astype(np.float64) ** 2).sum(axis=1))
        self.order = np.argsort(norms, kind="stable")
        self.norms, self.sorted = norms[self.order], entries[self.order]
        #: Entries measured so far, to see what pruning saves.
        self.measured = 0

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry of each point (n, width), ties to the lower index."""
        done = [self._nearest(points[at : at + BLOCK]) for at in range(0, len(points), BLOCK)] or [(np.zeros(0, np.int64),) * 2]
        return tuple(np.concatenate(x) for x in zip(*done, strict=True))

    def _nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, last = len(points), len(self.norms) - 1
        own = np.sqrt((points.astype(np.float64) ** 2).sum(axis=1))
        above = np.searchsorted(self.norms, own)
        first = np.minimum.reduce([((points - self.sorted[np.clip(i, 0, last)]) ** 2).sum(axis=1) for i in (above - 1, above)])
        reach = np.sqrt(first.astype(np.float64))
        reach += 1e-9 * (own + reach) + 1e-6  # borders belong to the annulus, however roots are rounded
        low, high = np.searchsorted(self.norms, own - reach, "left"), np.searchsorted(self.norms, own + reach, "right")
        width = high - low
        starts = np.cumsum(width) - width
        row = np.repeat(np.arange(n), width)
        place = np.arange(len(row)) - np.repeat(starts - low, width)
        far = ((points[row] - self.sorted[place]) ** 2).sum(axis=1)
        self.measured += len(far) + 2 * n
        best = np.minimum.reduceat(far, starts)
        return np.minimum.reduceat(np.where(far == best[row], self.order[place], len(self.norms)), starts), best


def _by_size(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Size, row numbers and parts of the batch's vectors of each length."""
    sizes = batch.column("x").value_lengths().to_numpy(zero_copy_only=False)
    for size in np.unique(sizes):
        some = np.flatnonzero(sizes == size)
        yield int(size), some, parts_of(matrix(batch.column("x").take(pa.array(some)), int(size)) if size else np.zeros((len(some), 0)))


def refined(rows: DataFrame, books: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """Every entry becomes the floor of the mean of the parts nearest to it; unused entries stay."""
    first, total = {}, 0
    for size, book in sorted(books.items()):
        first[size], total = total, total + book.size + book.shape[0] * book.shape[1]

    def part(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        sums = np.zeros(total, np.int64)
        annuli = {size: [Annuli(entries) for entries in book] for size, book in books.items()}
        for batch in batches:
            for size, _, points in _by_size(batch):
                book = books[size]
                at = sums[first[size] : first[size] + book.size + book.shape[0] * book.shape[1]].reshape(*book.shape[:2], -1)
                for p, known in enumerate(annuli[size]):
                    code, _ = known.nearest(points[:, p])
                    at[p, :, 0] += np.bincount(code, minlength=book.shape[1])
                    np.add.at(at[p, :, 1:], code, points[:, p])
        return sums

    sums, out = summed(rows.select("x"), part), {}
    for size, book in books.items():
        at = sums[first[size] : first[size] + book.size + book.shape[0] * book.shape[1]].reshape(*book.shape[:2], -1)
        count = at[:, :, :1]
        out[size] = np.where(count > 0, at[:, :, 1:] // np.maximum(count, 1), book)
    return out


def fit(rows: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> dict[int, np.ndarray]:
    """Codebooks (parts, entries, width) of every vector length in rows (vec_id, x).

    They start as the vectors of the smallest vec_ids (nulls last, rows of one
    id in the order of their components); fewer vectors give fewer entries.
    """
    books = {}
    for r in rows.select(F.size("x").alias("size")).distinct().collect():  # a row for each length
        first = rows.where(F.size("x") == r["size"]).orderBy(F.asc_nulls_last("vec_id"), "x").limit(entries).select("x").collect()
        books[r["size"]] = parts_of(np.array([f["x"] for f in first], np.int64).reshape(len(first), r["size"])).swapaxes(0, 1)
    for _ in range(rounds if books else 0):
        books = refined(rows, books)
    return books


def digest(book: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def encode(rows: DataFrame, books: dict[int, np.ndarray]) -> DataFrame:
    """vec_id, label, code, error and codebooks_sha256 of whole vectors (vec_id, label, x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        annuli = {size: [Annuli(entries) for entries in book] for size, book in books.items()}
        named = {size: digest(book) for size, book in books.items()}
        for batch in batches:
            for size, some, points in _by_size(batch):
                found = [known.nearest(points[:, p]) for p, known in enumerate(annuli[size])]
                codes = np.stack([c for c, _ in found], axis=1).astype(np.uint8).tobytes().hex()
                wide = 2 * points.shape[1]
                at = pa.array(some)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id").take(at), batch.column("label").take(at), pa.array([codes[i * wide : (i + 1) * wide] for i in range(len(some))]), pa.array(np.sum([d for _, d in found], axis=0)), pa.array([named[size]] * len(some))],
                    names=["vec_id", "label", "code", "error", "codebooks_sha256"],
                )

    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    return rows.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error bigint, codebooks_sha256 string")


def compress(vectors: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every vector, after ROUNDS rounds on all of them.

    Vectors that are null or hold null or non-finite components have no rows; a
    null vec_id or label stays (nulls are one label), repeated rows count and
    come out as often as they come in. Vectors of different lengths have
    codebooks of their own; a length that PARTS does not divide is filled up
    with zeros. Components of about 30,000 and more (64 of them; less for more)
    count as that, so that no error overflows; a label_error that a long can't
    hold is null. Extra columns are not read; no vectors, no rows.

    Sums of the labels are joined back, whatever share of the rows one label
    has: Spark sends them to all tasks if they are measured to be few, and
    splits the rows of a crowded label if not.
    """
    scratch = scratch or Scratch(vectors.sparkSession)
    rows = scratch.put(whole_vectors(vectors), "whole")
    coded = scratch.put(encode(rows, fit(rows)), "coded")
    by_label = scratch.put(coded.groupBy(F.col("label").alias("of")).agg(F.expr("try_sum(error)").alias("label_error")), "labels")
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("of")), "left").select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def oracle() -> str:
    """DuckDB SQL for ``compress`` on vectors of a length that PARTS divides: every entry is measured."""
    rounds = "".join(
        f""", near{k} AS MATERIALIZED (
  SELECT vec_id, part, min({{'far': far, 'entry': entry}}) AS best FROM (
    SELECT p.vec_id, p.part, b.entry, list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS far
    FROM parts p JOIN book{k} b USING (part)) GROUP BY ALL)"""
        + (
            f""", mean{k} AS (
  SELECT part, entry, list(floor_mean ORDER BY i) AS v FROM (
    SELECT part, entry, i, ((s - ((s % n) + n) % n) // n)::BIGINT AS floor_mean FROM (
      SELECT n.part, n.best.entry AS entry, i, sum(p.v[i])::HUGEINT AS s, count(*)::HUGEINT AS n
      FROM near{k} n JOIN parts p USING (vec_id, part), range(1, len(p.v) + 1) t(i) GROUP BY ALL)) GROUP BY ALL)
, book{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.v, b.v) AS v FROM book{k} b LEFT JOIN mean{k} m USING (part, entry))"""
            if k < ROUNDS
            else ""
        )
        for k in range(ROUNDS + 1)
    )
    return f"""WITH whole AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda c: floor({STEPS} * c::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = len(embedding))
, parts AS MATERIALIZED (SELECT vec_id, p AS part, x[p * len(x) // {PARTS} + 1 : (p + 1) * len(x) // {PARTS}] AS v FROM whole, range({PARTS}) t(p))
, first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM whole QUALIFY entry < {ENTRIES})
, book0 AS MATERIALIZED (SELECT part, entry, v FROM parts JOIN first USING (vec_id)){rounds}
, named AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book{ROUNDS})
, coded AS (SELECT vec_id, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, sum(best.far)::BIGINT AS error FROM near{ROUNDS} GROUP BY ALL)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
FROM coded JOIN whole USING (vec_id), named"""
