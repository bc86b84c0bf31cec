"""Sharding by a hierarchical weighted hash tree (law ``key``).

A tree of regions, racks and shards carries weights. A document descends it:
at each level every child draws ln(u) / weight, u a hash of (doc_id, path of
the child), and the largest draw wins. A draw depends on nothing but that
child, so when a weight changes, documents move only into the subtrees whose
weights grew or out of those whose weights shrank.

``grown`` adds a shard in a region and rack of its own once all are full: then
only draws of the new region are new, and documents move into the new shard
only. The default tree has three regions of two racks of four shards, 24 in
all, so the 25th shard opens a region.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RACKS, SHARDS, OVERHEAD, SLICE_ROWS = 2, 4, 8, 10_000


@dataclass(frozen=True)
class Tree:
    """Shard weights by (region, rack): weights[region][rack] = ((shard, weight), ...)."""

    weights: tuple[tuple[tuple[tuple[int, float], ...], ...], ...]

    @classmethod
    def of(cls, shards: int, racks: int = RACKS, per_rack: int = SHARDS) -> Tree:
        """Equal weights, filled region by region and rack by rack."""
        if shards < 1:
            raise ValueError("a tree needs at least one shard")
        step = racks * per_rack
        return cls(tuple(tuple(tuple((s, 1.0) for s in range(k, min(k + per_rack, shards))) for k in range(r, min(r + step, shards), per_rack)) for r in range(0, shards, step)))

    @property
    def n_shards(self) -> int:
        return sum(len(rack) for region in self.weights for rack in region)

    def grown(self, weight: float = 1.0) -> Tree:
        """The tree with one more shard, in a new region, so that no other subtree changes."""
        return Tree((*self.weights, (((self.n_shards, weight),),)))


def _descend(node: Column, key: str, children: dict[str, list[tuple[str, float]]]) -> Column:
    """The child with the largest weighted draw ln(u) / weight; ties go to the earlier child.

    u in (0, 1] comes from 52 bits of the MD5 of the child's path and the key.
    """
    known = F.create_map(*[x for name, below in children.items() for x in (F.lit(name), F.array(*[F.struct(F.lit(path).alias("path"), F.lit(float(w)).alias("weight"), F.lit(-n).alias("turn")) for n, (path, w) in enumerate(below)]))])
    drawn = F.transform(F.element_at(known, node), lambda c: F.struct((F.log((F.conv(F.substring(F.md5(F.concat(c["path"], F.lit(":"), F.col(key))), 1, 13), 16, 10).cast("double") + 1) / float(1 << 52)) / c["weight"]).alias("draw"), c["turn"].alias("turn"), c["path"].alias("path")))
    return F.array_max(drawn)["path"]


def _levels(tree: Tree) -> tuple[dict[str, list[tuple[str, float]]], ...]:
    """For each level the children (path, weight) of every path above."""
    regions, racks, shards = {"": []}, {}, {}
    for r, region in enumerate(tree.weights):
        regions[""].append((f"{r}", sum(w for rack in region for _, w in rack)))
        racks[f"{r}"] = [(f"{r}/{k}", sum(w for _, w in rack)) for k, rack in enumerate(region)]
        shards |= {f"{r}/{k}": [(f"{r}/{k}/{s}", w) for s, w in rack] for k, rack in enumerate(region)}
    return regions, racks, shards


def with_shard(rows: DataFrame, key: str, tree: Tree, out: str) -> DataFrame:
    """rows with the shard of the string column key, found by descending region, rack and shard."""
    node = F.lit("")
    for level in _levels(tree):
        rows = rows.withColumn(out, _descend(node, key, level))
        node = F.col(out)
    return rows.withColumn(out, F.substring_index(out, "/", -1).cast("int"))


def shard_documents(docs: DataFrame, tree: Tree | None = None, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Columns doc_id, size, text_crc32, law, shard, slot and grown_shard for each row.

    size: UTF-8 bytes of the text plus 8 (null text: 8). text_crc32: of the
    text's bytes (null: 0). The shard depends on doc_id and the tree only; a
    null doc_id is drawn like the empty key. slot counts a shard's rows from 0
    without gaps, in the order of (MD5 of doc_id, crc, size). Equal rows are
    counted first and numbered from their count, so that no task holds them.
    The rest is cut into slices by the first digits of the MD5, as many as give
    about ``slice_rows`` rows each; slices' counts are summed up, and only
    within a slice are rows numbered. Very long texts are measured like others.
    Extra columns are not read; an empty table gives no rows.
    """
    tree = tree or Tree.of(24)
    digits = max(0, math.ceil(math.log(max(1.0, docs.count() / (tree.n_shards * slice_rows)), 16)))
    blank = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key"), (F.octet_length(blank) + OVERHEAD).cast("bigint").alias("size"), F.crc32(blank.cast("binary")).alias("text_crc32"))
    same = sized.groupBy("doc_id", "key", "size", "text_crc32").agg(F.count("*").alias("copies")).withColumn("place", F.md5("key"))
    drawn = with_shard(with_shard(same, "key", tree, "shard"), "key", tree.grown(), "grown_shard").withColumn("slice", F.substring("place", 1, digits))
    upto = F.sum("copies").over(Window.partitionBy("shard", "slice").orderBy("place", "text_crc32", "size"))
    numbered = drawn.withColumn("number", upto - F.col("copies"))
    counts = drawn.groupBy("shard", "slice").agg(F.sum("copies").alias("n"))
    before = counts.select("shard", "slice", (F.sum("n").over(Window.partitionBy("shard").orderBy("slice")) - F.col("n")).alias("before"))
    each = numbered.join(before, ["shard", "slice"]).select("*", F.explode(F.expr("sequence(0L, copies - 1)")).alias("copy"))
    return each.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("before") + F.col("number") + F.col("copy")).alias("slot"), "grown_shard")


def oracle(shards: int = 24) -> str:
    """The same as DuckDB SQL over documents, for a tree of equal weights."""
    tree = Tree.of(shards)

    def levels(tree: Tree, name: str) -> str:
        regions, racks, leaves = _levels(tree)
        below = [(level, above, n, path, w) for level, children in enumerate((regions, racks, leaves)) for above, some in children.items() for n, (path, w) in enumerate(some)]
        rows = ", ".join(f"({level}, '{above}', {n}, '{path}', {w!r}::DOUBLE)" for level, above, n, path, w in below)
        draw = "ln((('0x' || substr(md5(c.path || ':' || p.key), 1, 13))::BIGINT::DOUBLE + 1) / 4503599627370496.0) / c.weight"
        step = lambda level, of: f"SELECT p.key, arg_max(c.path, {{'draw': {draw}, 'turn': -c.n}}) AS node FROM {of} p JOIN {name}_nodes c ON c.level = {level} AND c.above = p.node GROUP BY p.key"
        return f"""{name}_nodes(level, above, n, path, weight) AS (VALUES {rows}),
    {name}_0 AS (SELECT DISTINCT key, '' AS node FROM sized), {name}_1 AS ({step(0, f"{name}_0")}), {name}_2 AS ({step(1, f"{name}_1")}),
    {name} AS (SELECT key, split_part(node, '/', 3)::INT AS shard FROM ({step(2, f"{name}_2")}))"""

    # The CRC-32 of a text in SQL: a table of 256 remainders, made by its rule, folded over the bytes.
    return f"""
    WITH RECURSIVE remainders(i, r, k) AS (SELECT i, i, 0 FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN r % 2 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END, k + 1 FROM remainders WHERE k < 8),
    crc_table AS (SELECT list(r ORDER BY i) AS known FROM remainders WHERE k = 8),
    texts AS (SELECT DISTINCT coalesce(text, '') AS text FROM documents),
    bytes AS (SELECT text, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT) AS b FROM texts),
    summed AS (SELECT text, len(b) AS n_bytes, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda crc, x: xor(crc >> 8, known[1 + (xor(crc, x) & 255)])), 4294967295)::BIGINT AS crc FROM bytes, crc_table),
    sized AS (SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS key, n_bytes + {OVERHEAD} AS size, crc AS text_crc32 FROM documents d JOIN summed s ON coalesce(d.text, '') = s.text),
    {levels(tree, "now_")}, {levels(tree.grown(), "grown_")}
    SELECT s.doc_id, s.size::BIGINT AS size, s.text_crc32, 'key' AS law, a.shard, row_number() OVER (PARTITION BY a.shard ORDER BY md5(s.key), s.text_crc32, s.size) - 1 AS slot, g.shard AS grown_shard
    FROM sized s JOIN now_ a ON a.key = s.key JOIN grown_ g ON g.key = s.key"""
