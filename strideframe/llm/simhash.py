"""SimHash near-duplicate detection by meet-in-the-middle ball hashing.

A fingerprint has 64 bits; two fingerprints link at RADIUS = 3 or fewer
differing bits. The bits are cut into three blocks. Without the block where they
differ most, two linked fingerprints differ in at most two of some 43 bits, and
so they meet in the middle: every fingerprint emits, for each block left out,
all variants of the rest within half the radius (one bit), 132 in all. The
variants are shuffled once, those that are alone go, and pairs that collide are
deduplicated and verified on all 64 bits. Two random fingerprints collide with
a chance of 3e-10, so candidates stay below the fingerprints' own number up to
some billions of them.

A variant at which more than ``HOT`` different fingerprints meet (they may
differ anywhere in the block left out) would give quadratically many pairs. All
that meet there take the same idea on all 64 bits: a fingerprint emits its ball
of one bit (near) and of two bits (far). Whatever meets at a variant with a near member lies within three
bits of that member, so one link to it holds the group together and the links
grow with the emitted rows only. No case is dropped and nothing is capped.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strideframe.llm.runtime import Scratch, connected_components, text_batches

RADIUS, SHINGLE, SEED, HOT = 3, 3, 42, 32


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash of the word shingles of a text (null or no words: 0)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only \x20 \x09-\x0D part
    if not words:
        return 0
    parts = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(p, seed) for p in parts], dtype=">u8")
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(h), 65536):
        ones += np.unpackbits(h[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h)).tobytes(), "big")


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "fp") -> DataFrame:
    """The rows of docs with the column ``out``, a signed bigint."""
    text_batches(docs.sparkSession)

    @F.pandas_udf("bigint")
    def of(texts):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series(np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64))

    return docs.withColumn(out, of(F.col(text)))


#: Bits of the three blocks; a key is a fingerprint with one of them blanked.
BLOCKS = (range(0, 21), range(21, 42), range(42, 64))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _variants(fps: DataFrame) -> DataFrame:
    """key, fp: each fingerprint without one block, unchanged and with each other bit flipped.

    Keys of different blanked blocks may be equal by chance; what meets is verified anyway.
    """
    blank = [sum(1 << b for b in block) for block in BLOCKS]
    masks = F.array(*[F.struct(F.lit(_signed(~m & (1 << 64) - 1)).alias("mask"), F.array(F.lit(0), *[F.lit(_signed(1 << b)) for b in range(64) if not m >> b & 1]).alias("flips")) for m in blank])
    each = fps.select("fp", F.explode(masks).alias("m")).select("fp", F.col("fp").bitwiseAND(F.col("m.mask")).alias("base"), F.explode("m.flips").alias("flip"))
    return each.select(F.col("base").bitwiseXOR(F.col("flip")).alias("key"), "fp")


def _balls(fps: DataFrame) -> DataFrame:
    """Variants of whole fingerprints within one bit (far = 0) and at two bits (far = 1)."""
    flips = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i")).select("fp", "i", F.explode(F.expr("sequence(0, i)")).alias("j"))
    flipped = flips.select(F.expr("fp ^ (shiftleft(1L, i) | shiftleft(1L, j))").alias("z"), F.expr("int(j < i)").alias("far"), "fp")
    return flipped.union(fps.select(F.col("fp").alias("z"), F.lit(0).alias("far"), "fp"))


def fingerprint_links(fps: DataFrame, scratch: Scratch, hot: int = HOT) -> DataFrame:
    """Links (a, b) between different fingerprints with the components of the full graph.

    fps: distinct bigints in column fp. Every pair within RADIUS bits is linked
    directly or, at crowded keys, over a chain of such links.
    """
    key = Window.partitionBy("key").orderBy("fp")
    met = _variants(fps).select("key", "fp", F.lag("fp").over(key).alias("_before"), F.lead("fp").over(key).alias("_behind"))
    # Nearly all variants are alone; the rest is small.
    met = scratch.put(met.where("_before <> fp or _behind <> fp").select("key", "fp").distinct(), "met")
    crowded = scratch.put(met.groupBy("key").count().where(F.col("count") > hot).select("key"), "crowded")
    calm = met.join(crowded, "key", "left_anti")
    pairs = calm.withColumnRenamed("fp", "a").join(calm.withColumnRenamed("fp", "b"), "key")
    links = pairs.where(F.expr(f"a < b and bit_count(a ^ b) <= {RADIUS}")).select("a", "b")
    if not crowded.isEmpty():
        touching = scratch.put(met.join(crowded, "key", "left_semi").select("fp").distinct(), "touching")
        links = links.union(ball_links(touching, scratch))
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def ball_links(fps: DataFrame, scratch: Scratch) -> DataFrame:
    """Links by balls of all 64 bits: every member of a variant to its smallest near member."""
    variants = _balls(fps)
    centres = variants.groupBy("z").agg(F.min(F.when(F.col("far") == 0, F.col("fp"))).alias("a"), F.count("*").alias("n"), F.max("fp").alias("top")).where("a is not null and n > 1").select("z", "a", "n", "top")
    # The two of a pair are known from the centre itself; larger meetings are read again.
    pairs = scratch.put(centres, "centres")
    two = pairs.where("n = 2 and top <> a").select("a", F.col("top").alias("b"))
    more = variants.hint("merge").join(pairs.where("n > 2 or top = a").select("z", "a"), "z").select("a", F.col("fp").alias("b"))
    return two.union(more).where(F.expr(f"a <> b and bit_count(a ^ b) <= {RADIUS}")).distinct()


def _rooted(marked: DataFrame, scratch: Scratch, hot: int) -> DataFrame:
    """fp, first, n_same, root of each different fingerprint: its smallest doc_id, its rows, its component."""
    classes = scratch.put(marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.sum("n").alias("n_same")), "classes")
    links = scratch.put(fingerprint_links(classes.select("fp"), scratch, hot), "links")
    components = connected_components(links, scratch).withColumnsRenamed({"node": "fp", "component": "root"})
    return scratch.put(classes.join(components, "fp", "left").select("fp", "first", "n_same", F.coalesce("root", "fp").alias("root")), "rooted")


def near_duplicates(docs: DataFrame, scratch: Scratch | None = None, hot: int = HOT) -> DataFrame:
    """Near-duplicate classes: doc_id, fingerprint, component_id, n_same.

    fingerprint: 16 hex digits. component_id: the smallest doc_id that links
    reach. n_same: rows with this very fingerprint. Null and
    empty texts have the fingerprint zero and link like any other. Rows with a
    null doc_id keep their class; its component_id is null if the component
    holds no other id. Repeated rows are returned as often as they come; a very
    long text is hashed whole, in memory of its own size; extra columns are not
    read. An empty table gives no rows.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    marked = scratch.put(with_fingerprint(docs.select("doc_id", "text")).select("doc_id", "fp", F.lit(1).alias("n")), "marked")
    rooted = _rooted(marked, scratch, hot)
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = scratch.put(rooted.join(smallest, "root").select("fp", "component_id", "n_same"), "named")
    return marked.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_same")


def keep_one(docs: DataFrame, scratch: Scratch | None = None, hot: int = HOT) -> DataFrame:
    """docs with exactly one row of each near-duplicate component.

    It is the one with the smallest doc_id, of rows that share it the one with
    the smallest text hash; a null doc_id comes last. Rows equal in both are one. A doc_id with texts in
    several components may stay once in each. Columns as they are.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    marked = with_fingerprint(docs.select("doc_id", "text")).select("doc_id", F.xxhash64("text").alias("th"), "fp")
    marked = scratch.put(marked.groupBy("doc_id", "th", "fp").agg(F.count("*").alias("n")), "marked")
    rooted = _rooted(marked, scratch, hot)
    order = F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "th")
    first = marked.groupBy("fp").agg(F.min(order).alias("x")).join(rooted, "fp").groupBy("root").agg(F.min("x").alias("x"))
    same = [F.coalesce("doc_id", F.lit(0)).alias("_id"), F.isnull("doc_id").alias("_no"), F.xxhash64("text").alias("_th")]
    chosen = scratch.put(first.select(F.coalesce("x.doc_id", F.lit(0)).alias("_id"), F.col("x.no_id").alias("_no"), F.col("x.th").alias("_th")), "first")
    keys = ["_id", "_no", "_th"]
    # Rows equal in id and text meet in one place anyway; one of them stays.
    rows = docs.select(*same, F.struct("*").alias("_row")).join(chosen.hint("merge"), keys, "left_semi")
    one = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("_th"))).where("_n = 1")
    return one.select(*[F.col(f"_row.`{c}`") for c in docs.columns])


def brute_force(rows: list[tuple[int, str | None]]) -> dict[int, tuple[str, int]]:
    """For tests: every pair compared, on the driver."""
    fps = {i: fingerprint(t) for i, t in rows}
    root = {i: i for i in fps}

    def top(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(fps)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if (fps[a] ^ fps[b]).bit_count() <= RADIUS:
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {i: (f"{fps[i]:016x}", top(i)) for i in fps}
