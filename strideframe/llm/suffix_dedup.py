"""Removal of repeated byte strings by longest-previous-factor arrays over suffix arrays.

A byte goes if a string of LENGTH = 200 bytes that covers it occurs elsewhere.
The suffixes of a corpus do not fit one machine, so they are first brought
together by content:

1. Winnowing. The window of 200 bytes at a position holds 129 grams of 72
   bytes; the smallest gram hash is the window's anchor. Equal windows have
   equal anchors. Consecutive windows with one anchor form a block.
2. Anchors whose gram is found once are done: nothing there repeats. Blocks that are equal as
   a whole repeat as a whole; counting their hashes settles them, and thousands
   of copies are one partial count.
3. Different blocks of one anchor overlap in part (edges of passages and of
   edits). One text of each goes to its anchor; there the suffixes are put into
   order with the lengths that neighbours have in common, and previous and next
   smaller positions of that order give for each suffix the longest factor that
   occurs earlier (LPF) or, mirrored, later. Where that is LENGTH or more, the
   window repeats.
4. An anchor with more than CROWD different blocks is too much for one task.
   Its suffixes are split by their whole prefix of LENGTH bytes, that is, equal
   windows are counted by Spark, with the same result.

Hashes are 64-bit polynomials of the bytes; blocks are told apart by anchor and
content together (128 bits), crowded windows by 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideframe.llm.runtime import Scratch, text_batches

LENGTH, GRAM, RUN, SEGMENT, CROWD, CHUNK = 200, 72, 256, 1 << 20, 1000, 40_000


class Roller:
    """Polynomial hashes of substrings modulo 2^64, position-independent."""

    def __init__(self, size: int = 1 << 16):
        rng = np.random.default_rng(20)
        self.of_byte = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = 0x9E3779B97F4A7C15
        self.grow(size)

    def grow(self, size: int) -> None:
        inverse = pow(self.base, -1, 1 << 64)
        self.power, self.inverse = (np.cumprod(np.concatenate([np.ones(1, dtype=np.uint64), np.full(size, b, dtype=np.uint64)])) for b in (self.base, inverse))

    def sums(self, raw: np.ndarray) -> np.ndarray:
        if len(raw) >= len(self.power):
            self.grow(2 * len(raw))
        out = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(self.of_byte[raw] * self.power[: len(raw)], out=out[1:])
        return out

    def hashes(self, sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (sums[end] - sums[begin]) * self.inverse[begin]
        return _mix(h + (end - begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def grams(self, sums: np.ndarray, size: int) -> np.ndarray:
        n = len(sums) - size
        return _mix((sums[size:] - sums[:n]) * self.inverse[:n])


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _smallest(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    size = 1
    while size * 2 <= width:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[: len(h) - (width - size)], h[width - size :]) if size < width else h


def _repeat_inside(grams: np.ndarray, anchor: np.ndarray, width: int, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which blocks hold their anchor's gram more than once, so that windows may repeat within them."""
    pad = np.full(width - 1, ~np.uint64(0))
    at = np.flatnonzero(grams == ~_smallest(np.concatenate([pad, ~anchor, pad]), width))  # grams that are an anchor
    values, code = np.unique(grams[at], return_inverse=True)
    if len(values) == len(at):
        return np.zeros(len(begin), bool)
    span = len(grams) + 1
    keys = np.sort(code * span + at)
    of = np.searchsorted(values, anchor[begin]) * span
    return np.searchsorted(keys, of + begin + size + width - 1) - np.searchsorted(keys, of + begin) > 1


def blocks_of(raw: bytes, roller: Roller, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """First window, number of windows, anchor, content hash and inner repeat of each block of a text."""
    found = []
    for at in range(0, max(0, len(raw) - length + 1), SEGMENT):
        part = np.frombuffer(raw, np.uint8)[at : at + SEGMENT + length - 1]
        sums = roller.sums(part)
        grams, width = roller.grams(sums, gram), length - gram + 1
        anchor = _smallest(grams, width)
        begin = np.concatenate([[0], np.flatnonzero(anchor[1:] != anchor[:-1]) + 1])
        size = np.diff(np.append(begin, len(anchor)))
        if size.max() > RUN:  # a text that repeats itself
            begin = np.concatenate([np.arange(b, b + s, RUN) for b, s in zip(begin, size, strict=True)])
            size = np.diff(np.append(begin, len(anchor)))
        found.append((begin + at, size, anchor[begin], roller.hashes(sums, begin, begin + size + length - 1), _repeat_inside(grams, anchor, width, begin, size)))
    if not found:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64, bool))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def suffix_order(text: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes at ``starts`` in the order of their first ``length`` bytes (equal ones by position), and how many of these neighbours have in common (0 for the first)."""
    heads = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(text, length)[starts])
    order = np.argsort(heads.view(f"S{length}").ravel(), kind="stable")
    heads = heads[order]
    differ = heads[1:] != heads[:-1]
    return order, np.append(0, np.where(differ.any(axis=1), differ.argmax(axis=1), length))


def longest_previous(order: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Longest previous factors of suffixes 0..n-1.

    order: the suffix array; common[i]: common prefix of order[i - 1] and
    order[i] (common[0] = 0). A suffix that is later in the text than both its
    neighbours has its previous and next smaller positions beside it: the longer
    of the two prefixes is its factor. All such suffixes leave at once and their
    neighbours meet over the shorter prefix. Where few leave in a round (a text
    that repeats itself) a stack takes over.
    """
    out = np.zeros(len(order), dtype=np.int64)
    at, prefix = np.asarray(order), np.append(common, 0)
    for _ in range(40):
        if len(at) < 64:
            break
        top = (at > np.append(-1, at[:-1])) & (at > np.append(at[1:], -1))
        k = np.flatnonzero(top)
        out[at[k]] = np.maximum(prefix[k], prefix[k + 1])
        prefix[k + 1] = np.minimum(prefix[k], prefix[k + 1])
        at, prefix = at[~top], prefix[np.append(~top, True)]
    stack: list[tuple[int, int]] = []  # position, common prefix with the entry below
    for position, shared in zip([*at.tolist(), -1], prefix.tolist(), strict=True):
        while stack and stack[-1][0] > position:
            last, below = stack.pop()
            out[last] = max(below, shared)
            shared = min(below, shared)
        stack.append((position, shared))
    return out


def repeats(contents: list[bytes], length: int = LENGTH) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each content (in text order) which windows occur earlier, and which earlier or later."""
    sizes = [len(c) - length + 1 for c in contents]
    ends = np.cumsum([len(c) for c in contents])
    starts = np.concatenate([np.arange(e - len(c), e - length + 1) for c, e in zip(contents, ends, strict=True)])
    order, common = suffix_order(np.frombuffer(b"".join(contents), np.uint8), starts, length)
    earlier = longest_previous(order, common) >= length
    # Read from its end, the order and its prefixes give what comes later.
    other = earlier | (longest_previous(len(order) - 1 - order, common)[::-1] >= length)
    cuts = np.cumsum(sizes)[:-1]
    return np.split(earlier, cuts), np.split(other, cuts)


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edges[::2], edges[1::2] - 1


def _keyed(docs: DataFrame, *more: Column) -> DataFrame:
    """did and th tell a text of a document; rows that repeat both are one.

    th is a hash of the text. Many texts may share a null doc_id, so a second
    hash stands in for it: 128 bits tell them apart.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.coalesce("doc_id", F.xxhash64(F.lit(1), text)).alias("did"), F.xxhash64(text).alias("th"), text.alias("body"), *more)


def _blocks(keyed: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller = Roller()
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                made = [blocks_of(t.encode("utf-8", "surrogatepass"), roller) for t in part.column("body").to_pylist()]
                times = [len(m[0]) for m in made]
                first, size, anchor, content, inner = (np.concatenate([m[i] for m in made]) for i in range(5))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column("did").to_numpy(), times)), pa.array(np.repeat(part.column("th").to_numpy(), times)), pa.array(first), pa.array(size.astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64)), pa.array(inner)], names=["did", "th", "first", "size", "v", "c", "inner"])

    return keyed.select("did", "th", "body").mapInArrow(run, "did bigint, th bigint, first bigint, size int, v bigint, c bigint, inner boolean")


_SPANS = "did bigint, th bigint, low bigint, high bigint, earlier boolean"


def _texts(keyed: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted blocks (v, did, th, first, size) with their bytes, once each however many rows repeat the text."""
    lists = wanted.groupBy("did", "th").agg(F.collect_list(F.struct("v", "first", "size")).alias("list"))  # as many as the text has blocks

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 200):
                out = []
                for did, th, body, v, first, size in pdf.iloc[at : at + 200].itertuples(index=False):
                    raw = body.encode("utf-8", "surrogatepass")
                    for a, f, s in sorted({*zip(v.tolist(), first.tolist(), size.tolist(), strict=True)}):
                        out.append((a, did, th, f, raw[f : f + s + LENGTH - 1]))
                yield pd.DataFrame(out, columns=["v", "did", "th", "first", "bytes"])

    one = keyed.select("did", "th", "body").dropDuplicates(["did", "th"]).join(lists, ["did", "th"]).select("did", "th", "body", "list.v", "list.first", "list.size")
    return one.mapInPandas(run, "v bigint, did bigint, th bigint, first bigint, bytes binary")


def _by_suffixes(texts: DataFrame) -> DataFrame:
    """Spans of windows that repeat among the blocks of each anchor."""

    def spans(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        earlier, other = repeats(pdf["bytes"].tolist())
        for did, th, first, e, o in zip(pdf["did"], pdf["th"], pdf["first"], earlier, other, strict=True):
            for flags, kind in ((e, True), (o & ~e, False)):
                low, high = _runs(flags)
                out += [(did, th, first + a, first + b, kind) for a, b in zip(low, high, strict=True)]
        return pd.DataFrame(out, columns=["did", "th", "low", "high", "earlier"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in batches:
            rest = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            v = rest["v"].to_numpy()
            begins = np.concatenate([[0], np.flatnonzero(v[1:] != v[:-1]) + 1]) if len(v) else np.zeros(1, int)
            weight = np.concatenate([[0], np.cumsum([len(b) - LENGTH + 1 for b in rest["bytes"]])])
            cut = 0
            for nxt in begins[1:]:
                if weight[nxt] - weight[cut] >= CHUNK:
                    yield spans(rest.iloc[cut:nxt])
                    cut = nxt
            rest = rest.iloc[cut:].reset_index(drop=True)
        if rest is not None and len(rest):
            yield spans(rest)

    return texts.repartition("v").sortWithinPartitions("v", "did", "th", "first").mapInPandas(run, _SPANS)


def _by_windows(texts: DataFrame, scratch: Scratch) -> DataFrame:
    """The same for crowded anchors: every window is a row, equal ones are counted."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 500):
                part = pdf.iloc[at : at + 500]
                sizes = [len(b) - LENGTH + 1 for b in part["bytes"]]
                digest = [hashlib.blake2b(b[i : i + LENGTH], digest_size=16).digest() for b, s in zip(part["bytes"], sizes, strict=True) for i in range(s)]
                h = np.frombuffer(b"".join(digest), "<i8").reshape(-1, 2)
                pos = np.concatenate([f + np.arange(s) for f, s in zip(part["first"], sizes, strict=True)])
                yield pd.DataFrame({"h1": h[:, 0], "h2": h[:, 1], "did": np.repeat(part["did"].to_numpy(), sizes), "th": np.repeat(part["th"].to_numpy(), sizes), "pos": pos})

    windows = scratch.put(texts.mapInPandas(run, "h1 bigint, h2 bigint, did bigint, th bigint, pos bigint"), "windows")
    shared = scratch.put(windows.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(F.struct("did", "th", "pos")).alias("one")).where("n > 1").select("h1", "h2", "one"), "shared_windows")
    return windows.join(shared, ["h1", "h2"]).select("did", "th", F.col("pos").alias("low"), F.col("pos").alias("high"), F.expr("(did, th, pos) <> one").alias("earlier"))


def repeated_spans(docs: DataFrame, scratch: Scratch, crowd: int = CROWD) -> DataFrame:
    """did, th and spans [low, high] of windows that occur elsewhere; earlier: also before.

    The order of texts is that of (doc_id, hash of the text, position).
    """
    text_batches(docs.sparkSession)
    keyed = _keyed(docs)
    blocks = scratch.put(_blocks(keyed), "blocks")
    anchors = scratch.put(blocks.groupBy("v").agg(F.count("*").alias("n"), F.min("c").alias("a"), F.max("c").alias("b"), F.max("inner").alias("inner")).where("n > 1 or inner").select("v", F.expr("a <> b or inner").alias("mixed")), "anchors")
    hits = scratch.put(blocks.drop("inner").join(anchors, "v"), "hits")
    scratch.drop(blocks)
    contents = scratch.put(hits.groupBy("v", "c").agg(F.count("*").alias("n"), F.min(F.struct("did", "th", "first", "size")).alias("one"), F.first("mixed").alias("mixed")), "contents")
    whole = hits.join(contents.where("n > 1").select("v", "c", "one"), ["v", "c"]).select("did", "th", F.col("first").alias("low"), (F.col("first") + F.col("size") - 1).alias("high"), F.expr("(did, th, first, size) <> one").alias("earlier"))
    mixed = contents.where("mixed").select("v", "one.*")
    crowded = scratch.put(mixed.groupBy("v").count().where(F.col("count") > crowd).select("v"), "crowded")
    out = whole
    if crowded.isEmpty():
        out = out.union(_by_suffixes(_texts(keyed, mixed)))
    else:
        texts = scratch.put(_texts(keyed, mixed), "texts")
        out = out.union(_by_suffixes(texts.join(crowded, "v", "left_anti"))).union(_by_windows(texts.join(crowded, "v", "left_semi"), scratch))
    return out


def _removed(low, high, earlier, n: int, kind: str) -> list[tuple[int, int]]:  # noqa: ANN001
    """Byte ranges [begin, end) that windows at the spans cover, merged; no spans, no ranges."""
    if low is None:
        return []
    begin, end = np.asarray(low), np.minimum(n, np.asarray(high) + LENGTH)
    if kind == "later":
        mask = np.asarray(earlier, dtype=bool)
        begin, end = begin[mask], end[mask]
    if not len(begin):
        return []
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(begin[1:] > end[:-1]) + 1
    return list(zip(begin[np.append(0, new)].tolist(), end[np.append(new - 1, len(end) - 1)].tolist(), strict=True))


def _joined(docs: DataFrame, scratch: Scratch, crowd: int, *more: Column) -> DataFrame:
    """did, th, body, the further columns and the spans of each row as three arrays (NULL without any)."""
    spans = scratch.put(repeated_spans(docs, scratch, crowd), "spans")
    lists = spans.groupBy("did", "th").agg(F.collect_set(F.struct("low", "high", "earlier")).alias("list"))  # bounded by the text
    return _keyed(docs, *more).join(lists, ["did", "th"], "left").withColumns({c: F.col(f"list.{c}") for c in ("low", "high", "earlier")}).drop("list")


def removal_digests(docs: DataFrame, keep_first: bool = False, scratch: Scratch | None = None, crowd: int = CROWD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row.

    keep_first: only later copies go, in the order of (doc_id, hash of the
    text, position); otherwise every copy goes. Null texts are empty. Rows that
    repeat doc_id and text are copies of each other, so all of their windows go;
    with keep_first they are one text. A null doc_id stands in the order where
    a hash of the text puts it.
    Extra columns are not read.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    kind = "later" if keep_first else "all"

    def of(body: str, *spans) -> tuple[int, int, int, str]:  # noqa: ANN002
        raw = body.encode("utf-8", "surrogatepass")
        gone = _removed(*spans, len(raw), kind)
        kept, at = hashlib.sha256(), 0
        for a, b in gone:
            kept.update(raw[at:a])
            at = b
        kept.update(raw[at:])
        return len(raw), sum(b - a for a, b in gone), len(gone), kept.hexdigest()

    @F.pandas_udf("n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
    def digest(bodies: pd.Series, lows: pd.Series, highs: pd.Series, earliers: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([of(*row) for row in zip(bodies, lows, highs, earliers, strict=True)], columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])

    made = _joined(docs, scratch, crowd, F.col("doc_id").alias("_id"))
    return made.select(F.col("_id").alias("doc_id"), digest("body", "low", "high", "earlier").alias("r")).select("doc_id", "r.*")


def remove_copies(docs: DataFrame, scratch: Scratch | None = None, crowd: int = CROWD) -> DataFrame:
    """docs without later copies of repeated strings; texts stay valid and n_chars follows them.

    A removed range is narrowed to whole characters. A document of which
    nothing is left was a copy altogether and goes; one that was empty stays.
    """
    scratch = scratch or Scratch(docs.sparkSession)

    @F.pandas_udf("string")
    def cut(bodies: pd.Series, lows: pd.Series, highs: pd.Series, earliers: pd.Series) -> pd.Series:
        out = []
        for body, *spans in zip(bodies, lows, highs, earliers, strict=True):
            raw, parts, at = body.encode("utf-8", "surrogatepass"), [], 0
            for a, b in _removed(*spans, len(raw), "later"):
                while a < b and raw[a] & 0xC0 == 0x80:
                    a += 1
                while b < len(raw) and b > a and raw[b] & 0xC0 == 0x80:
                    b -= 1
                parts.append(raw[at:a])
                at = b
            out.append(b"".join([*parts, raw[at:]]).decode("utf-8", "surrogatepass"))
        return pd.Series(out)

    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    made = _joined(docs, scratch, crowd, rest.alias("_row"), F.col("text").isNull().alias("_null"))
    made = made.select("_row", "_null", "body", F.when(F.col("low").isNull(), F.col("body")).otherwise(cut("body", "low", "high", "earlier")).alias("kept"))
    made = made.where("kept <> '' or body = ''")
    fields = {f.name: f.dataType for f in docs.schema.fields}
    column = {"text": F.when(~F.col("_null"), F.col("kept")).alias("text")}
    if "n_chars" in fields:
        column["n_chars"] = F.when(F.col("kept") == F.col("body"), F.col("_row.n_chars")).otherwise(F.length("kept")).cast(fields["n_chars"]).alias("n_chars")
    return made.select(*[column.get(c, F.col(f"_row.`{c}`")) for c in docs.columns])


def brute_force(rows: list[tuple[int, str | None]], length: int = LENGTH) -> dict[int, tuple[int, int, int, str]]:
    """For tests: every window of every text in one dictionary."""
    seen: dict[bytes, int] = {}
    raw = [(i, (t or "").encode()) for i, t in rows]
    for _, b in raw:
        for p in range(len(b) - length + 1):
            seen[b[p : p + length]] = seen.get(b[p : p + length], 0) + 1
    out = {}
    for i, b in raw:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out[i] = (len(b), int(gone.sum()), len(_runs(gone)[0]), hashlib.sha256(kept).hexdigest())
    return out
