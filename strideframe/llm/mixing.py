"""Mixing sources to target weights by hierarchical budgeting.

Leaves are the sources of a language of a domain. Capacities (tokens times the
epochs a leaf may be repeated) are summed up the tree, then the budget goes
down it: a node's children share its budget in proportion to their weights;
what a child cannot hold goes to its siblings, and only where a whole subtree
is full does the rest reach the level above, because a subtree never gets more
than its capacity. All is integer arithmetic in DataFrame operations.

A leaf's budget is filled from seeded epochs: in each epoch the leaf's
documents stand in the order of a seeded hash, and the prefix whose tokens fit
is taken. Prefix sums run over hash slices first and over rows only inside a
slice, so a leaf with a third of all rows is not one task.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideframe.llm.runtime import Scratch, clear_of

LEVELS = ("domain", "lang", "source")
WORDS = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Mix:
    """Targets. Weights are whole numbers; names without one have ``other``.

    domains: domain -> weight; langs: language -> weight within each domain;
    sources: source -> weight within each language. share: budget in
    thousandths of all tokens. epochs: how often a leaf may be used. seed:
    orders the documents. hex_digits: slices of a leaf are 16 to that power.
    """

    domains: dict[str, int] = field(default_factory=lambda: {"d0": 4, "d1": 3, "d2": 2, "d3": 1})
    langs: dict[str, int] = field(default_factory=lambda: {"en": 5, "de": 2, "fr": 2, "es": 1})
    sources: dict[str, int] = field(default_factory=dict)
    other: int = 1
    share: int = 500
    epochs: int = 2
    seed: int = 7
    hex_digits: int = 3


def n_words(text: Column) -> Column:
    """Words of a text, the token measure of the mix (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("bigint")


def domain_of(source: Column) -> Column:
    """The domain of a source: its trailing number modulo 4, as d0 to d3 (without a number: d0)."""
    return F.concat(F.lit("d"), F.pmod(F.coalesce(F.nullif(F.regexp_extract(source, r"(\d{1,9})$", 1), F.lit("")).cast("int"), F.lit(0)), F.lit(4)))


def _weight(name: str, weights: dict[str, int], other: int) -> Column:
    out = F.lit(other).cast("bigint")
    for k, v in sorted(weights.items()):
        out = F.when(F.col(name) == k, F.lit(v).cast("bigint")).otherwise(out)
    return out


def share_budget(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Adds ``given``: the children's shares of the parent's ``budget``.

    nodes has the parent's columns, name, cap, weight and budget. Children are
    put in the order of cap / weight; a child is full if it would be even when
    all later ones rise to its level. The others share what is left by
    weight, rounded down; remainders stay unspent (less than one token a child).
    """
    ratio = F.col("cap").cast("double") / F.col("weight")
    order = Window.partitionBy(*parent).orderBy(ratio, name)
    whole = Window.partitionBy(*parent)
    n = nodes.withColumns({"_cap": F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, 0)), "_after": F.sum("weight").over(whole) - F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    big = lambda c: F.col(c).cast("decimal(38,0)")
    n = n.withColumn("_full", big("weight") * big("_cap") + big("cap") * big("_after") <= big("budget") * big("weight"))
    n = n.withColumns({"_held": F.coalesce(F.sum(F.when(F.col("_full"), F.col("cap"))).over(whole), F.lit(0)), "_open": F.sum(F.when(~F.col("_full"), F.col("weight"))).over(whole)})
    part = F.expr("cast(weight as decimal(19,0)) * cast(budget - _held as decimal(19,0)) div cast(_open as decimal(19,0))")
    given = F.when(F.col("_full"), F.col("cap")).otherwise(F.least(part.cast("bigint"), F.col("cap")))
    return n.withColumn("given", given).drop("_cap", "_after", "_full", "_held", "_open")


def leaf_budgets(sized: DataFrame, mix: Mix) -> DataFrame:
    """domain, lang, source, tokens, given of each leaf; sized has these three and tokens."""
    leaves = sized.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"))
    leaves = leaves.withColumn("cap", F.col("tokens") * mix.epochs)
    langs = leaves.groupBy("domain", "lang").agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens"))
    domains = langs.groupBy("domain").agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens"))
    root = domains.withColumns({"_all": F.lit(1), "weight": _weight("domain", mix.domains, mix.other)})
    root = root.withColumn("budget", F.expr(f"sum(tokens) over (partition by _all) * {mix.share} div 1000")).drop("tokens")
    given = share_budget(root, ["_all"], "domain").select("domain", F.col("given").alias("budget"))
    for level, above, weights in ((langs, ["domain"], mix.langs), (leaves, ["domain", "lang"], mix.sources)):
        name = LEVELS[len(above)]
        nodes = level.join(given, above).withColumn("weight", _weight(name, weights, mix.other))
        shared = share_budget(nodes, above, name)
        given = shared.select(*above, name, F.col("given").alias("budget"), *(["tokens"] if name == "source" else []))
    return given.withColumnRenamed("budget", "given")


def mix_sources(docs: DataFrame, mix: Mix | None = None, tokens: Column | None = None, domain: Column | None = None, scratch: Scratch | None = None) -> DataFrame:
    """The selected rows of docs with tokens, domain, epoch and take.

    A row comes once for each epoch it is taken in, epoch counting from 0.
    Documents are whole: the last that would pass the budget is left out, and
    so are all behind it. take: the tokens taken in the leaf up to and with
    this row. Null lang or source count as the name ''. Documents without
    words or with a null doc_id take no part (nothing to draw or to order by).
    Rows that repeat a doc_id are ordered by their token counts and then stand
    together: equal rows share one place, so that either all or none are taken.
    Very long texts count like others. Extra columns are carried along; columns
    of docs named tokens, domain, epoch or take are replaced.
    """
    mix, scratch = mix or Mix(), scratch or Scratch(docs.sparkSession)
    named = clear_of(docs, "tokens", "domain", "epoch", "take")
    identity = F.xxhash64("text", *[c for c in (tokens, domain) if c is not None])
    sized = scratch.put(measured(named, tokens, domain, identity), "sized")  # words are counted once
    chosen = sized.join(choose(sized.drop("th"), mix), ["doc_id", *LEVELS, "tokens"]).distinct()
    rows = named.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), identity.alias("th"), F.struct("*").alias("_row"))
    joined = rows.join(chosen.hint("merge"), ["doc_id", "lang", "source", "th"])
    return joined.select(*[F.col(f"_row.`{c}`") for c in named.columns], "tokens", "domain", "epoch", "take")


def measured(docs: DataFrame, tokens: Column | None = None, domain: Column | None = None, identity: Column | None = None) -> DataFrame:
    """doc_id, domain, lang, source, tokens of the rows that take part; identity is added as th."""
    out = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), (tokens if tokens is not None else n_words(F.col("text"))).alias("tokens"), (domain if domain is not None else domain_of(F.coalesce("source", F.lit("")))).alias("domain"), *([identity.alias("th")] if identity is not None else []))
    return out.where("tokens > 0 and doc_id is not null")


def choose(sized: DataFrame, mix: Mix) -> DataFrame:
    """doc_id, domain, lang, source, tokens, epoch, take of what is selected, without texts.

    sized is read several times, so it should be a stored table. A leaf has
    16^hex_digits slices an epoch: their number is a setting, and a window over
    them holds no more rows than that.
    """
    leaf = list(LEVELS)
    budgets = leaf_budgets(sized, mix).where("given > 0")
    one = sized.groupBy("doc_id", *leaf, "tokens").agg(F.count("*").alias("copies"))
    # Whole epochs come first; the last one is the prefix of the rest.
    drawn = one.select("*", F.explode(F.sequence(F.lit(0), F.lit(mix.epochs - 1))).alias("epoch"))
    drawn = drawn.withColumn("place", F.md5(F.concat_ws(":", F.lit(str(mix.seed)), "epoch", "doc_id")))
    drawn = drawn.withColumns({"slice": F.substring("place", 1, mix.hex_digits), "weight": F.col("tokens") * F.col("copies")})
    slices = drawn.groupBy(*leaf, "epoch", "slice").agg(F.sum("weight").alias("tokens"))
    begin = F.sum("tokens").over(Window.partitionBy(*leaf).orderBy("epoch", "slice")) - F.col("tokens")
    starts = slices.withColumn("begin", begin).drop("tokens").join(budgets.drop("tokens"), leaf).where("begin < given")
    upto = F.sum("weight").over(Window.partitionBy(*leaf, "epoch", "slice").orderBy("place", "doc_id", "tokens"))
    taken = drawn.withColumn("upto", upto).join(starts, [*leaf, "epoch", "slice"])
    return taken.withColumn("take", F.col("begin") + F.col("upto")).where("take <= given").select("doc_id", *leaf, "tokens", "epoch", "take")


def oracle(mix: Mix | None = None) -> str:
    """The same selection as DuckDB SQL over documents."""
    mix = mix or Mix()

    def case(column: str, weights: dict[str, int]) -> str:
        return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in sorted(weights.items())) + f" ELSE {mix.other} END" if weights else str(mix.other)

    def fill(nodes: str, parent: str, name: str) -> str:
        return f"""SELECT *, CASE WHEN full_ THEN cap ELSE least((weight::HUGEINT * (budget - held) // open_)::BIGINT, cap) END AS given FROM (
          SELECT *, coalesce(sum(CASE WHEN full_ THEN cap END) OVER (PARTITION BY {parent}), 0) AS held, sum(CASE WHEN NOT full_ THEN weight END) OVER (PARTITION BY {parent}) AS open_ FROM (
            SELECT *, weight::HUGEINT * cum + cap::HUGEINT * (allw - cumw) <= budget::HUGEINT * weight AS full_ FROM (
              SELECT *, sum(cap) OVER w AS cum, sum(weight) OVER w AS cumw, sum(weight) OVER (PARTITION BY {parent}) AS allw FROM ({nodes})
              WINDOW w AS (PARTITION BY {parent} ORDER BY cap::DOUBLE / weight, {name} ROWS UNBOUNDED PRECEDING))))"""

    return f"""
    WITH sized AS (
      SELECT doc_id, 'd' || (coalesce(try_cast(nullif(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1), '') AS INT), 0) % 4) AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS tokens FROM documents WHERE doc_id IS NOT NULL),
    rows_ AS (SELECT * FROM sized WHERE tokens > 0),
    leaves AS (SELECT domain, lang, source, (sum(tokens) * {mix.epochs})::BIGINT AS cap FROM rows_ GROUP BY ALL),
    langs AS (SELECT domain, lang, sum(cap)::BIGINT AS cap FROM leaves GROUP BY ALL),
    domains AS (SELECT domain, sum(cap)::BIGINT AS cap FROM langs GROUP BY ALL),
    g1 AS ({fill(f"SELECT domain, cap, {case('domain', mix.domains)} AS weight, (SELECT sum(tokens) * {mix.share} // 1000 FROM rows_) AS budget, 1 AS all_ FROM domains", "all_", "domain")}),
    g2 AS ({fill(f"SELECT l.domain, l.lang, l.cap, {case('l.lang', mix.langs)} AS weight, g1.given AS budget FROM langs l JOIN g1 USING (domain)", "domain", "lang")}),
    g3 AS ({fill(f"SELECT l.domain, l.lang, l.source, l.cap, {case('l.source', mix.sources)} AS weight, g2.given AS budget FROM leaves l JOIN g2 USING (domain, lang)", "domain, lang", "source")}),
    placed AS (
      SELECT r.*, e.epoch, md5('{mix.seed}:' || e.epoch || ':' || doc_id) AS place FROM rows_ r, (SELECT unnest(range({mix.epochs}))::INT AS epoch) e),
    summed AS (
      SELECT *, (sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY epoch, place, doc_id, tokens RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS take FROM placed)
    SELECT doc_id, domain, s.lang, s.source, tokens, epoch, take FROM summed s JOIN g3 USING (domain, lang, source) WHERE take <= g3.given"""
