"""Toxic spans by a linear-chain conditional random field.

Documents are labelled, words are not, so labelled words are drawn from them
first: a *pattern* is a word or the beginning of words; it is telling if it
occurs in toxic documents far more often than chance allows, counted over
distinct contexts (the words beside it), so that copies of a document count
once. In a toxic document the words that a telling pattern covers are labelled
toxic, all others are not.

The field has two states a word. Its weights are those of the patterns, a bias
and three transitions; they are fitted by full gradients, each one a sum over
partitions of forward-backward expectations. The log-odds of a document against
one of its length without telling words (the difference of their log
partition functions) become its score by isotonic regression, on documents that
the weights have not seen. Words whose marginal reaches one half are offending.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideframe.llm.quality_classifier import isotonic
from strideframe.llm.runtime import Scratch, summed

#: Labelled rows that the fit reads at most, those of the smallest hashes of their ids; telling patterns at most.
SAMPLE, PATTERNS = 8000, 4096
#: A telling pattern is RATIO times as frequent in toxic documents, and G2 (log likelihood ratio) tells it from chance.
RATIO, G2 = 4.0, 25.0
#: Letters of beginnings; words of more letters than LONG are known by their beginnings only.
SHORTEST, LONGEST, LONG = 3, 8, 40
#: Words of a sequence in training; ridge, steps and folds of the fit; cells, lowest and highest log-odds of the calibration.
WINDOW, RIDGE, STEPS, FOLDS, GRID, LOW, HIGH = 256, 0.1, 40, 2, 1000, -2.0, 38.0
THRESHOLD, OFFENDING, REMEMBERED, SETTLED = 0.5, 0.5, 200_000, 10_000
WORD = re.compile(r"[^\W_]+")
_FIXED = 4  # bias, and transitions into, out of and inside toxic words


def _lower(word: str) -> str:
    return word if word.islower() else word.lower()


class Lexicon:
    """Telling patterns: ``=word`` or ``^beginning``. A word's signature is the longest that covers it (0: none)."""

    def __init__(self, patterns: list[str]):
        self.patterns = sorted(patterns)
        self.index = {p: i for i, p in enumerate(self.patterns, 1)}
        self._known: dict[str, int] = {}

    def __reduce__(self):
        return Lexicon, (self.patterns,)

    def covering(self, word: str) -> list[int]:
        """Numbers of the patterns that cover a lower-case word, longest first."""
        made = ["=" + word] if len(word) <= LONG else []
        made += ["^" + word[:k] for k in range(min(LONGEST, len(word)), SHORTEST - 1, -1)]
        return [self.index[p] for p in made if p in self.index]

    def _learn(self, word: str) -> int:
        found = (self.covering(_lower(word)) or [0])[0]
        if len(word) <= LONG:
            if len(self._known) >= REMEMBERED:
                self._known.clear()
            self._known[word] = found
        return found

    def signatures(self, words: list[str]) -> list[int]:
        known = list(map(self._known.get, words))
        if None in known:
            known = [self._learn(w) if k is None else k for w, k in zip(words, known, strict=True)]
        return known

    def cover(self) -> np.ndarray:
        """(signatures, patterns): which patterns cover the words of each signature."""
        out = np.zeros((len(self.patterns) + 1, len(self.patterns)))
        for p, i in self.index.items():
            out[i, [j - 1 for j in self.covering(p[1:]) if p[0] == "=" or self.patterns[j - 1][0] == "^"]] = 1
        return out


def forward_backward(psi: np.ndarray, live: np.ndarray, into: np.ndarray, out: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals (models, rows, words) and expected transitions (3, models, rows) of padded sequences.

    psi is the weight of the toxic state of each word, against 1; live marks
    words; into, out and inside (models,) are the weights of the transitions
    plain-toxic, toxic-plain and toxic-toxic, against 1 for plain-plain.
    """
    models, rows, words = psi.shape
    a, b = np.empty((2, *psi.shape)), np.ones((2, *psi.shape))
    into, out, inside = (x[:, None] for x in (into, out, inside))
    plain = np.ones((models, rows))
    toxic = psi[:, :, 0]
    for t in range(words):
        if t:
            plain, toxic = plain + toxic * out, (plain * into + toxic * inside) * psi[:, :, t]
        total = plain + toxic
        plain, toxic = plain / total, toxic / total
        a[0, :, :, t], a[1, :, :, t] = plain, toxic
    for t in range(words - 2, -1, -1):
        of = b[1, :, :, t + 1] * psi[:, :, t + 1]
        plain, toxic = b[0, :, :, t + 1] + into * of, out * b[0, :, :, t + 1] + inside * of
        total = np.where(live[None, :, t + 1], plain + toxic, 1.0)
        b[0, :, :, t] = np.where(live[None, :, t + 1], plain / total, 1.0)
        b[1, :, :, t] = np.where(live[None, :, t + 1], toxic / total, 1.0)
    near = a * b
    marginals = near[1] / near.sum(axis=0) * live
    before, after = a[:, :, :, :-1], b[:, :, :, 1:] * np.stack([np.ones_like(psi[:, :, 1:]), psi[:, :, 1:]])
    pairs = np.stack([before[0] * after[1] * into[:, :, None], before[1] * after[0] * out[:, :, None], before[1] * after[1] * inside[:, :, None]])
    return marginals, (pairs / (pairs.sum(axis=0) + before[0] * after[0]) * live[None, None, :, 1:]).sum(axis=3)


def gradient(weights: np.ndarray, cover: np.ndarray, signatures: list[np.ndarray], toxic: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Of the log likelihood, for each model (models, weights); sequence r counts ``counts[m, r]`` times for model m."""
    rows, words = len(signatures), max(map(len, signatures))
    sig, live = np.zeros((rows, words), np.int64), np.zeros((rows, words), bool)
    for r, s in enumerate(signatures):
        sig[r, : len(s)], live[r, : len(s)] = s, True
    emission = np.exp(np.clip(weights[:, _FIXED:] @ cover.T + weights[:, :1], -30, 30))
    marginals, pairs = forward_backward(emission[:, sig], live, *np.exp(weights[:, 1:_FIXED].T))
    y = (sig > 0) & toxic[:, None]
    seen = np.stack([(~y[:, :-1] & y[:, 1:]).sum(axis=1), (y[:, :-1] & ~y[:, 1:] & live[:, 1:]).sum(axis=1), (y[:, :-1] & y[:, 1:]).sum(axis=1)])
    over = (y[None] - marginals) * counts[:, :, None]
    by_signature = np.stack([np.bincount(sig.ravel(), o.ravel(), minlength=len(cover)) for o in over])
    return np.hstack([over.sum(axis=(1, 2))[:, None], ((seen[:, None] - pairs) * counts[None]).sum(axis=2).T, by_signature @ cover])


@dataclass
class Field:
    """A fitted field: its weights, and the calibration's steps (log-odds, share of toxic documents)."""

    lexicon: Lexicon
    weights: np.ndarray
    at: np.ndarray = field(default_factory=lambda: np.zeros(1))
    level: np.ndarray = field(default_factory=lambda: np.zeros(1))

    def __post_init__(self) -> None:
        self._psi = np.exp(np.clip(self.lexicon.cover() @ self.weights[_FIXED:] + self.weights[0], -30, 30)).tolist()
        self._into, self._out, self._inside = np.exp(self.weights[1:_FIXED]).tolist()
        # Log weights of plain chains: of all steps but the last, and of the last state; both settle long before.
        self._body, self._close, ratio = [0.0], [0.0], 0.0
        for n in range(SETTLED):
            step, ratio = self._step(ratio, self._psi[0], n == 0)
            self._body.append(self._body[-1] + math.log(step))
            self._close.append(math.log1p(ratio))
        self._rise = math.log(self._step(ratio, self._psi[0], False)[0])

    def _step(self, ratio: float, psi: float, first: bool) -> tuple[float, float]:
        """The plain state's new weight over its old one, and the toxic state's over the plain one's."""
        if first:
            return 1.0, psi
        plain = 1.0 + ratio * self._out
        return plain, psi * (self._into + ratio * self._inside) / plain

    def plain(self, n: int) -> float:
        """Log partition function of n words that no pattern covers."""
        if n <= SETTLED:
            return self._body[n] + self._close[n]
        return self._body[-1] + (n - SETTLED) * self._rise + self._close[-1]

    def read(self, words: list[str], signatures: list[int] | None = None) -> tuple[float, list[float] | None]:
        """Log-odds of a document, and the marginals of its words (None: no word is covered)."""
        sig = self.lexicon.signatures(words) if signatures is None else signatures
        if not any(sig):
            return 0.0, None
        into, out, inside = self._into, self._out, self._inside
        psi = list(map(self._psi.__getitem__, sig))
        ratio, scale, total, ratios = psi[0], 1.0, 0.0, [psi[0]]
        for p in psi[1:]:
            plain = 1.0 + ratio * out
            ratio = p * (into + ratio * inside) / plain
            ratios.append(ratio)
            scale *= plain
            if scale > 1e200:
                total, scale = total + math.log(scale), 1.0
        total += math.log(scale) + math.log1p(ratio)
        back, marginals = 1.0, []
        for r, p in zip(reversed(ratios), reversed(psi), strict=True):
            odds = r * back
            marginals.append(odds / (1.0 + odds))
            back = (out + inside * p * back) / (1.0 + into * p * back)
        marginals.reverse()
        return total - self.plain(len(words)), marginals

    def score(self, odds: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(odds, self.at, self.level), 0, 1)


def _contexts(train: DataFrame) -> DataFrame:
    """Distinct word, context (the hash of the words beside it) and y of the words of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
                words = [w[:LONG] for w in map(_lower, WORD.findall(text))]
                around = list(zip(["", *words], words, [*words[1:], ""], strict=False))
                some = list(set(around))
                if some:
                    yield pa.RecordBatch.from_pydict({"before": [x[0] for x in some], "word": [x[1] for x in some], "after": [x[2] for x in some], "y": [y] * len(some)}, pa.schema([("before", pa.string()), ("word", pa.string()), ("after", pa.string()), ("y", pa.int32())]))

    told = train.select("text", "y").mapInArrow(run, "before string, word string, after string, y int")
    return told.select("word", F.xxhash64("before", "after").alias("context"), "y").distinct()


def telling_patterns(train: DataFrame) -> Lexicon:
    """Patterns of the toxic texts (text, y) that pass the tests, by falling G2, PATTERNS at most.

    A beginning must pass without its most frequent continuation as well: else
    that says it better.
    """
    words = _contexts(train).groupBy("word").agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("c"))
    chain = F.expr(f"concat(transform(filter(sequence({SHORTEST}, {LONGEST}), k -> k <= length(word)), k -> concat('^', left(word, k))), case when length(word) < {LONG} then array(concat('=', word)) else array() end)")
    links = words.withColumn("chain", chain).select("t", "c", F.expr("transform(chain, (p, i) -> struct(p as pattern, case when i > 0 then chain[i - 1] end as parent))").alias("links"))
    each = links.select("t", "c", F.explode("links").alias("x")).groupBy("x.pattern", "x.parent").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    sums = words.agg(F.sum("t").alias("all_t"), F.sum("c").alias("all_c")).first()
    most_t, most_c = float(sums["all_t"] or 0), float(sums["all_c"] or 0)
    if not most_t or not most_c:
        return Lexicon([])
    share = most_t / (most_t + most_c)

    def g2(t: Column, c: Column) -> Column:
        n = (t + c).cast("double")
        part = lambda x, p: F.when(x > 0, x * F.log(x / (n * p))).otherwise(0.0)
        return F.when(t / most_t > RATIO * (c + 0.5) / most_c, 2 * (part(t, share) + part(c, 1 - share))).otherwise(0.0)

    best = each.where("parent is not null").groupBy(F.col("parent").alias("pattern")).agg(F.max(F.struct("t", "c")).alias("m"))
    rest = each.join(best, "pattern", "left").select("pattern", g2(F.col("t"), F.col("c")).alias("g"), g2(F.col("t") - F.coalesce("m.t", F.lit(0)), F.col("c") - F.coalesce("m.c", F.lit(0))).alias("r"))
    found = rest.where(F.least("g", "r") >= G2).orderBy(F.desc("g"), "pattern").limit(PATTERNS).select("pattern").collect()
    return Lexicon([r["pattern"] for r in found])


def _fitted(windows: DataFrame, lexicon: Lexicon) -> np.ndarray:
    """Weights of FOLDS + 1 fields: without the sequences of each fold, and of all. windows: signatures, y, fold."""
    cover, size = lexicon.cover(), _FIXED + len(lexicon.patterns)
    weights = np.tile(np.r_[-4.0, np.zeros(size - 1)], (FOLDS + 1, 1))
    step, before = np.full(weights.shape, 0.5), np.zeros(weights.shape)
    for _ in range(STEPS):  # signs of gradients with a step for each weight: the likelihood is concave

        def part(batches: Iterator[pa.RecordBatch], weights: np.ndarray = weights) -> np.ndarray:
            total = np.zeros(weights.shape)
            for batch in batches:
                for at in range(0, batch.num_rows, 500):
                    some = batch.slice(at, 500)
                    fold = some.column("fold").to_numpy()
                    counts = np.stack([*((fold != k) * 1.0 for k in range(FOLDS)), np.ones(len(fold))])
                    total += gradient(weights, cover, [s.values.to_numpy() for s in some.column("signatures")], some.column("y").to_numpy() == 1, counts)
            return total.ravel()

        slope = summed(windows, part).reshape(weights.shape) - RIDGE * weights
        turned = np.sign(slope * before)
        step = np.clip(step * np.where(turned > 0, 1.2, np.where(turned < 0, 0.5, 1.0)), 1e-4, 2.0)
        before = np.where(turned < 0, 0.0, slope)
        weights = weights + np.sign(before) * step
    return weights


def _windows(train: DataFrame, lexicon: Lexicon) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list] = [], [], []
            for text, y, fold in zip(*(batch.column(c).to_pylist() for c in ("text", "y", "fold")), strict=True):
                sig = lexicon.signatures(WORD.findall(text))
                for at in range(0, len(sig), WINDOW):
                    for to, v in zip(out, (sig[at : at + WINDOW], y, fold), strict=True):
                        to.append(v)
            yield pa.RecordBatch.from_pydict(dict(zip(("signatures", "y", "fold"), out, strict=True)), pa.schema([("signatures", pa.list_(pa.int32())), ("y", pa.int32()), ("fold", pa.int32())]))

    return train.mapInArrow(run, "signatures array<int>, y int, fold int")


def fit(docs: DataFrame, labels: DataFrame, scratch: Scratch, sample: int = SAMPLE) -> Field | float:
    """The field of the labelled rows that are not held out (``sample`` of them at most), or the score all texts share: labels of one kind are that label, none are 0.

    Repeated labels of a doc_id count as their mean rounded up, and so do those of equal texts, which count once.
    """
    known = labels.where("toxic in (0, 1) and doc_id is not null and crc32(cast(doc_id as string)) % 5 <> 0").groupBy("doc_id").agg(F.ceil(F.avg("toxic")).cast("int").alias("y"))
    drawn = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    some = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(drawn), "doc_id").select("text", "y")  # bounded by sample
    train = scratch.put(some.groupBy("text").agg(F.ceil(F.avg("y")).cast("int").alias("y")).withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int")), "train")
    kinds = train.agg(F.count("*").alias("n"), F.avg("y").alias("y")).first()
    if not kinds["n"] or kinds["y"] in (0.0, 1.0):
        return float(kinds["y"] or 0.0)
    lexicon = telling_patterns(train)
    weights = _fitted(scratch.put(_windows(train, lexicon), "windows"), lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [Field(lexicon, w) for w in weights[:FOLDS]]
        for batch in batches:
            odds = [fields[fold].read(WORD.findall(text))[0] for text, fold in zip(batch.column("text").to_pylist(), batch.column("fold").to_pylist(), strict=True)]
            cell = np.clip((np.array(odds) - LOW) * GRID / (HIGH - LOW), 0, GRID - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(cell), batch.column("y")], names=["cell", "y"])

    cells = sorted(train.mapInArrow(run, "cell int, y int").groupBy("cell").agg(F.sum("y").alias("t"), F.count("*").alias("n")).collect())  # at most GRID rows
    middle = np.array([LOW + (r["cell"] + 0.5) * (HIGH - LOW) / GRID for r in cells])
    at, level = isotonic(middle, np.array([r["t"] for r in cells], dtype=float), np.array([r["n"] for r in cells], dtype=float))
    return Field(lexicon, weights[FOLDS], at, level)


def tag(docs: DataFrame, model: Field | float) -> DataFrame:
    """doc_id, score, n_words and spans (begin, end, marginal) of each row of docs.

    A span is a run of offending words, in code points of the text; its marginal is the largest of its words.
    """
    span = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())]))

    def spans(text: str, marginals: list[float]) -> list[dict]:
        out: list[dict] = []
        last = -2
        bad = [k for k, p in enumerate(marginals) if p >= OFFENDING]
        if bad:
            at = iter(bad)
            k = next(at)
            for i, m in enumerate(WORD.finditer(text)):
                if i < k:
                    continue
                if k == last + 1:
                    out[-1]["end"], out[-1]["marginal"] = m.end(), max(out[-1]["marginal"], marginals[k])
                else:
                    out.append({"begin": m.start(), "end": m.end(), "marginal": marginals[k]})
                last, k = k, next(at, -1)
                if k < 0:
                    break
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            odds, counts, found = [], [], []
            for text in batch.column("text"):
                text = text.as_py() or ""
                words = WORD.findall(text)
                counts.append(len(words))
                one, marginals = model.read(words) if isinstance(model, Field) else (0.0, None)
                odds.append(one)
                found.append(spans(text, marginals) if marginals else [])
            scores = model.score(np.array(odds)) if isinstance(model, Field) else np.full(len(odds), model)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(counts, pa.int64()), pa.array(found, span)], names=["doc_id", "score", "n_words", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, n_words bigint, spans array<struct<begin: int, end: int, marginal: double>>")


def classify(docs: DataFrame, labels: DataFrame, scratch: Scratch | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted, n_words and spans of each row of docs.

    Labels are learned from rows whose crc32(doc_id as text) modulo 5 is not 0
    (held_out marks those), of which the fit reads SAMPLE at most. Nothing but
    the text enters a score. Null and empty texts have no words and the score
    of a text without telling words; a very long text is read whole, in memory
    in proportion to it. With labels of one kind every score is that label,
    without any it is 0. A row with a null doc_id is scored; it is not held out.
    Repeated rows get equal scores; no rows, no rows. Extra columns are not read.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    tagged = tag(docs, fit(docs, labels, scratch))
    held = F.coalesce(F.expr("crc32(cast(doc_id as string)) % 5 = 0"), F.lit(False))
    return tagged.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_words", "spans")
