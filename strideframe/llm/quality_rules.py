"""Quality rules: a learned decision list over text statistics, in Spark expressions only.

Sequential covering: rules that reject are learned one after the other from
labelled statistics. A rule grows by the threshold condition with the largest
FOIL gain on two thirds of the labelled rows and is pruned to the prefix with
the best (p - n) / (p + n) on the other third; what it covers leaves the
training rows and the next rule is grown. The list becomes one ordered CASE
expression. Only counts by feature, threshold and label reach the driver, a
number of rows that does not depend on the data.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideframe.llm.runtime import Scratch

BLANK = r"\x20\x09-\x0D"
SYMBOLS = "#*$%&|<>"
BLANKS = "".join(map(chr, [0x20, *range(0x09, 0x0E)]))

BASE_FAILED = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"

#: Ratios that conditions may test, as SQL over the columns of ``statistics``.
FEATURES = {
    "words": "cast(n_words as double)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "mark_share": "n_marks / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
}
BINS, MAX_RULES, MAX_CONDITIONS, MIN_PRECISION, MIN_COVER = 40, 10, 3, 0.75, 2


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and counts of each whole text (null: an empty text; a very long one is read whole).

    Words are runs of other characters than ASCII white space. A 3-word window
    is told from others by its XXH64, within one text.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("t"))
    rows = rows.select("doc_id", "t", F.regexp_extract_all("t", F.lit(f"[^{BLANK}]+"), F.lit(0)).alias("w"))
    count = lambda chars: F.length("t") - F.length(F.translate("t", chars, ""))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(f"[^{BLANK}]"))
    grams = F.when(F.size("w") >= 3, F.expr("sort_array(transform(sequence(0, size(w) - 3), i -> struct(xxhash64(w[i], w[i + 1], w[i + 2]) as h, i as i)))"))
    rows = rows.select("doc_id", F.size("w").cast("bigint").alias("n_words"), count(BLANKS).cast("bigint").alias("_blank"), F.length("t").cast("bigint").alias("_all"), count(SYMBOLS).cast("bigint").alias("n_symbols"), F.regexp_count("t", F.lit(r"\p{Lu}")).cast("bigint").alias("n_upper"), count("!?").cast("bigint").alias("n_marks"), count("0123456789").cast("bigint").alias("n_digits"), lines.alias("l"), grams.alias("g"))
    repeated = F.expr("filter(g, (x, k) -> x.h <=> get(g, k - 1).h or x.h <=> get(g, k + 1).h)")
    rows = rows.withColumn("r", repeated)
    covered = F.size(F.array_distinct(F.expr("flatten(transform(r, x -> array(x.i, x.i + 1, x.i + 2)))")))
    return rows.select("doc_id", "n_words", (F.col("_all") - F.col("_blank")).alias("word_chars"), "n_symbols", (F.size("l") - F.size(F.array_distinct("l"))).cast("bigint").alias("n_dup_lines"), F.when(F.size("r") > 0, covered).otherwise(0).cast("bigint").alias("n_repeat_words"), "n_upper", "n_marks", "n_digits", F.size("l").cast("bigint").alias("n_lines"))


def base(stats: DataFrame) -> DataFrame:
    """The base statistics and base_failed of rows of ``statistics``; no labels needed."""
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", F.expr(BASE_FAILED).alias("base_failed"))


def base_oracle() -> str:
    """``base`` over documents as DuckDB SQL."""
    word = r"[^\x20\x09-\x0D]"
    return f"""
    WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
    split AS (SELECT r, doc_id, t, regexp_extract_all(t, '{word}+') AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{word}')) AS lines FROM docs),
    grams AS (SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM split)),
    twice AS (SELECT r, i FROM grams QUALIFY count(*) OVER (PARTITION BY r, gram) > 1),
    covered AS (SELECT r, count(DISTINCT i + d) AS n FROM twice, range(3) x(d) GROUP BY r)
    SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM (
      SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words FROM split LEFT JOIN covered USING (r))"""


@dataclass(frozen=True)
class Condition:
    """feature >= bound or feature < bound."""

    feature: str
    above: bool
    bound: float

    def sql(self) -> str:
        return f"({FEATURES[self.feature]}) {'>=' if self.above else '<'} {self.bound!r}D"


@dataclass(frozen=True)
class DecisionList:
    """Rules in order; each one rejects what all its conditions hold for."""

    rules: tuple[tuple[Condition, ...], ...]

    def keeps(self) -> Column:
        """One CASE: the first rule that holds rejects, else the document is kept."""
        if not self.rules:
            return F.lit(True)
        out = None
        for rule in self.rules:
            holds = F.expr(" AND ".join(c.sql() for c in rule))
            out = F.when(holds, F.lit(False)) if out is None else out.when(holds, F.lit(False))
        return out.otherwise(F.lit(True))


def _counts(rows: DataFrame, bounds: dict[str, list[float]]) -> dict[Condition, tuple[int, int]]:
    """For each condition the bad and the good rows it covers; rows have bad and bins."""
    got = rows.select("bad", F.posexplode("bins").alias("f", "b")).groupBy("f", "b").agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n")).collect()  # at most features x bins rows
    table = {(r["f"], r["b"]): (r["p"], r["n"]) for r in got}
    out = {}
    for i, f in enumerate(FEATURES):
        cells = [table.get((i, b), (0, 0)) for b in range(len(bounds[f]) + 1)]
        for k, bound in enumerate(bounds[f], 1):
            for above, part in ((True, cells[k:]), (False, cells[:k])):
                out[Condition(f, above, bound)] = (sum(p for p, _ in part), sum(n for _, n in part))
    return out


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p and p0 else 0.0


def learn(labelled: DataFrame, scratch: Scratch) -> DecisionList:
    """A decision list from statistics with the columns bad (0 or 1) and grow (boolean)."""
    measured = scratch.put(labelled.select("bad", "grow", *[F.expr(sql).alias(f) for f, sql in FEATURES.items()]), "measured")
    quantiles = [k / BINS for k in range(1, BINS)]
    parts = [F.percentile_approx(F.when(F.col("bad") == b, F.col(f)), quantiles, 2000).alias(f"{f}_{b}") for f in FEATURES for b in (0, 1)]
    found = measured.agg(*parts).first()  # one row
    bounds = {f: sorted({*(found[f"{f}_0"] or []), *(found[f"{f}_1"] or [])}) for f in FEATURES}
    # A bin is the number of bounds that the value reaches.
    bins = [F.expr(f"size(filter(array({', '.join(f'{b!r}D' for b in bounds[f])}), b -> {f} >= b))") if bounds[f] else F.lit(0) for f in FEATURES]
    rows = scratch.put(measured.select("bad", "grow", F.array(*bins).alias("bins")), "binned")
    place = {f: i for i, f in enumerate(FEATURES)}
    one = lambda c: f"bins[{place[c.feature]}] {'>=' if c.above else '<'} {bounds[c.feature].index(c.bound) + 1}"
    holds = lambda rule: F.expr(" AND ".join(map(one, rule)) or "true")
    rules: list[tuple[Condition, ...]] = []
    while len(rules) < MAX_RULES:
        left = reduce(lambda df, r: df.where(~holds(r)), rules, rows)
        rule, start = (), None
        while len(rule) < MAX_CONDITIONS:
            counts = _counts(left.where("grow").where(holds(rule)), bounds)
            if not counts:
                break
            if start is None:  # a condition and its opposite cover all rows
                both = list(counts.values())[:2]
                start = (both[0][0] + both[1][0], both[0][1] + both[1][1])
            best = max(counts, key=lambda c: (_gain(*counts[c], *start), -counts[c][1]))
            if _gain(*counts[best], *start) <= 0 or counts[best][0] < MIN_COVER:
                break
            rule, start = (*rule, best), counts[best]
            if not start[1]:
                break
        if not rule:
            break
        # Pruning: the prefix that does best on the rows held back.
        tests = [F.sum(F.when(holds(rule[:k]), w).otherwise(0)).alias(f"{c}{k}") for k in range(1, len(rule) + 1) for c, w in (("p", F.col("bad")), ("n", 1 - F.col("bad")))]
        seen = left.where("not grow").agg(*tests).first()
        worth = {k: (seen[f"p{k}"] or 0, seen[f"n{k}"] or 0) for k in range(1, len(rule) + 1)}
        k = max(worth, key=lambda i: ((worth[i][0] - worth[i][1]) / max(1, sum(worth[i])), worth[i][0]))
        p, n = worth[k]
        if p < MIN_COVER or p / (p + n) < MIN_PRECISION:
            break
        rules.append(rule[:k])
    return DecisionList(tuple(rules))


def quality_rules(docs: DataFrame, labels: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """statistics of every row, base_failed and kept.

    base_failed: fewer than 50 words, or more than half of the words repeated.
    kept: false if base_failed, else the learned list's verdict. Labels are
    taken from rows with quality 0 or 1 whose crc32(doc_id) modulo 4 is not 2,
    which stay for held-out accuracy; repeated labels of a doc_id count once,
    as the smallest. Without labels nothing but the base rejects. Null texts
    are empty texts. Repeated rows are judged alike, extra columns not read.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    stats = scratch.put(statistics(docs), "statistics")
    marks = labels.where("quality in (0, 1) and doc_id is not null and crc32(cast(doc_id as string)) % 4 <> 2").groupBy("doc_id").agg((1 - F.min("quality")).alias("bad"))
    labelled = stats.join(marks, "doc_id").withColumn("grow", F.expr("crc32(cast(doc_id as string)) % 3 <> 0"))
    rules = learn(labelled, scratch)
    return stats.withColumn("base_failed", F.expr(BASE_FAILED)).withColumn("kept", ~F.col("base_failed") & rules.keeps())
