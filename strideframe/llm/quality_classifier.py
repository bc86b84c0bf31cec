"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

Each text becomes a vector of statistics. Random Fourier features approximate
a Gaussian kernel over the standardised statistics. Every partition sums its
part of the normal equations, the parts are added up in a few groups, and the
driver solves one system whose size depends on the number of features only.
Raw scores are calibrated by isotonic regression on counts in a fixed grid, of
rows that the scoring weights have not seen.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe.llm.runtime import Scratch, text_batches

WIDTH, RIDGE, SEED, GROUPS, GRID, FOLDS, THRESHOLD = 192, 1.0, 11, 24, 1000, 2, 0.7
NAMES = ("log_words", "word_length", "long_words", "distinct", "symbols", "upper", "digits", "marks", "stops", "non_ascii", "lines", "dup_lines", "repeats", "top_word", "ends_in_symbol")
_SYMBOL = np.frombuffer(b"#*$%&|<>", dtype=np.uint8)


def statistics(text: str | None) -> list[float]:
    """The statistics NAMES of a whole text (null: those of an empty one)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [0.0] * len(NAMES)
    n = len(words)
    by = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    solid = max(1, len(raw) - int(by[[9, 10, 11, 12, 13, 32]].sum()))
    often = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    grams = len(set(zip(words, words[1:], words[2:], strict=False))) if n > 2 else n
    return [
        float(np.log1p(n)), solid / n, sum(len(w) > 12 for w in often) / len(often), len(often) / n,
        by[_SYMBOL].sum() / solid, by[65:91].sum() / solid, by[48:58].sum() / solid, (by[33] + by[63]) / solid, by[46] / n, by[128:].sum() / solid,
        len(lines) / n, 1 - len(set(lines)) / max(1, len(lines)), 1 - grams / max(1, n - 2) if n > 2 else 0.0, often.most_common(1)[0][1] / n if n > 9 else 0.0,
        sum(k for w, k in often.items() if w[-1] in b"#*$%&|<>") / n,
    ]


def statistics_of(column: str) -> Column:
    """The statistics of a text column as array<double>."""

    text_batches(SparkSession.active())

    @F.pandas_udf("array<double>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([[float(v) for v in statistics(t)] for t in texts])

    return of(F.col(column))


@dataclass(frozen=True)
class Model:
    """mean, scale of the statistics; directions, phases, weights of the features; the calibration's steps."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    at: np.ndarray
    level: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([np.cos(z @ self.directions + self.phases) * np.sqrt(2 / len(self.phases)), np.ones((len(z), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.at, self.level), 0, 1)


def isotonic(value: np.ndarray, total: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the rising steps (value, share) that fit total / count best."""
    blocks: list[list[float]] = []  # sum of value * count, total, count
    for v, t, c in zip(value, total, count, strict=True):
        blocks.append([v * c, t, c])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def _normal_equations(rows: DataFrame, model: Model) -> list[tuple[np.ndarray, np.ndarray]]:
    """X'X and X'y over (stats, y) of each fold: each partition sums, then GROUPS tasks a fold add the sums."""
    d = len(model.phases) + 1
    upper = np.triu_indices(d)

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = [(np.zeros((d, d)), np.zeros(d)) for _ in range(FOLDS)]
        for pdf in batches:
            for fold, of in pdf.groupby("fold"):
                x = model.features(np.vstack(of["stats"].to_numpy()))
                sums[fold] = (sums[fold][0] + x.T @ x, sums[fold][1] + x.T @ of["y"].to_numpy())
        group = TaskContext.get().partitionId() % GROUPS
        yield pd.DataFrame({"fold": range(FOLDS), "g": group, "v": [np.concatenate([a[upper], b]).astype("<f8").tobytes() for a, b in sums]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(v, "<f8") for v in sorted(pdf["v"])], axis=0)
        return pd.DataFrame({"fold": [pdf["fold"].iloc[0]], "v": [total.tobytes()]})

    added = rows.mapInPandas(part, "fold int, g int, v binary").groupBy("fold", "g").applyInPandas(add, "fold int, v binary").collect()  # at most FOLDS x GROUPS rows
    out = []
    for fold in range(FOLDS):
        total = np.sum([np.zeros(len(upper[0]) + d), *(np.frombuffer(v, "<f8") for v in sorted(bytes(r["v"]) for r in added if r["fold"] == fold))], axis=0)
        a = np.zeros((d, d))
        a[upper] = total[:-d]
        out.append((a + np.triu(a, 1).T, total[-d:]))
    return out


def fit(train: DataFrame) -> Model | float | None:
    """Fit on rows (stats, y, fold); the share of good ones if they are of one class; None without rows.

    The ridge weights come from all rows. For the calibration every row is
    scored by weights of the other folds, whose sums are at hand anyway.
    """
    n = len(NAMES)
    moments = train.agg(F.count("*").alias("n"), F.avg("y").alias("y"), *[f(F.col("stats")[i]).alias(f"{c}{i}") for i in range(n) for c, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    if not moments["n"]:
        return None
    if moments["y"] in (0.0, 1.0):
        return float(moments["y"])
    mean = np.array([moments[f"m{i}"] for i in range(n)])
    scale = np.maximum(np.array([moments[f"s{i}"] for i in range(n)]), 1e-6)
    rng = np.random.default_rng(SEED)
    model = Model(mean, scale, rng.normal(size=(n, WIDTH)) / np.sqrt(n), rng.uniform(0, 2 * np.pi, WIDTH), np.zeros(WIDTH + 1), np.zeros(1), np.zeros(1))
    sums = _normal_equations(train, model)
    ridge = RIDGE * np.eye(WIDTH + 1)
    ridge[-1, -1] = 1e-9
    solved = lambda some: np.linalg.solve(sum(a for a, _ in some) + ridge, sum(b for _, b in some))
    others = [replace(model, weights=solved([s for k, s in enumerate(sums) if k != fold])) for fold in range(FOLDS)]

    @F.pandas_udf("int")
    def cell(stats: pd.Series, fold: pd.Series) -> pd.Series:
        out = np.zeros(len(stats), np.int32)
        for k in np.unique(fold):
            at = np.flatnonzero(fold == k)
            out[at] = np.clip((others[k].raw(np.vstack(stats.to_numpy()[at])) + 0.5) * GRID / 2, 0, GRID - 1)
        return pd.Series(out)

    cells = sorted(train.select(cell("stats", "fold").alias("cell"), "y").groupBy("cell").agg(F.sum("y").alias("t"), F.count("*").alias("n")).collect())  # at most GRID rows
    at, level = isotonic(np.array([(r["cell"] + 0.5) * 2 / GRID - 0.5 for r in cells]), np.array([r["t"] for r in cells], dtype=float), np.array([r["n"] for r in cells], dtype=float))
    return replace(model, weights=solved(sums), at=at, level=level)


def scorer(stats: DataFrame, labels: DataFrame, scratch: Scratch) -> Callable[[Column], Column]:
    """Learns from the labelled rows of stats (doc_id, stats) and gives the score of a stats column."""
    known = labels.where("quality in (0, 1) and doc_id is not null and crc32(cast(doc_id as string)) % 4 <> 2").groupBy("doc_id").agg(F.ceil(F.avg("quality")).cast("double").alias("y"))
    fold = F.expr(f"cast(crc32(cast(doc_id as string)) div 4 % {FOLDS} as int)")
    model = fit(scratch.put(stats.join(known, "doc_id").select("stats", "y", fold.alias("fold")), "train"))
    if not isinstance(model, Model):
        return lambda _: F.lit(1.0 if model is None else model)

    @F.pandas_udf("double")
    def of(rows: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.vstack(rows.to_numpy()))) if len(rows) else pd.Series([], dtype="float64")

    return of


def classify(docs: DataFrame, labels: DataFrame, scratch: Scratch | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of docs.

    Labels are learned from rows whose crc32(doc_id as text) modulo 4 is not 2
    (held_out marks those); repeated labels of a doc_id count once, as their
    mean rounded up. Nothing but the text enters a score. Null and empty texts
    have statistics zero; a very long text is read whole, in memory of its own
    size. With labels of one kind every score is that label, without any it is 1
    (nothing is rejected unless a label says so). A row with a null doc_id is
    scored; it is not held out. Repeated rows get equal scores. Extra columns
    are not read.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    stats = scratch.put(docs.select("doc_id", statistics_of("text").alias("stats")), "statistics")
    held = F.coalesce(F.expr("crc32(cast(doc_id as string)) % 4 = 2"), F.lit(False))
    score = scorer(stats, labels, scratch)
    return stats.select("doc_id", held.alias("held_out"), score(F.col("stats")).alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accept(docs: DataFrame, labels: DataFrame, scratch: Scratch | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that the classifier rejects, each judged by its own text; columns as they are.

    Statistics of the labelled rows are stored for the fit; to judge the rest
    they are computed where the row is, so that no text is copied or shuffled.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    known = labels.where("quality in (0, 1)").select("doc_id").distinct()
    stats = docs.select("doc_id", "text").join(known, "doc_id", "left_semi").select("doc_id", statistics_of("text").alias("stats"))
    score = scorer(stats, labels, scratch)
    return docs.where(score(statistics_of("text")) >= threshold)
