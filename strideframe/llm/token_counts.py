"""Token counts that follow edits.

A document is kept as a segment tree over its pre-tokens: leaves of some LEAF
pre-tokens hold their characters and tokens, inner nodes the sums. An edit
finds its leaves by descending the character sums. Encoding starts again at a
leaf boundary that no pre-token before it looks across to the edit, and stops at
the first pre-token that ends on an old leaf boundary behind the edit: from there
on the text is the old one, so its pre-tokens are too. Only these leaves are
encoded anew, and only the sums above them change. Trees live as long as their
row is worked on; they are not stored.

How far a pre-token looks is that of the pattern given (public_tokenizers.PATTERN
and others of its family, whose white-space rules stop at the run's end): at the
character behind it, a contraction at three characters from its apostrophe, and
white space at its whole run and the character behind that. Encoding so starts at or before the end of the last other character ahead
of the edit, and two characters ahead of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.llm.bpe import Coder, Vocabulary
from strideframe.llm.runtime import text_batches, without_gc

LEAF, REMEMBER, SHORT = 16, 500_000, 200
EDITS = "array<struct<position: bigint, deleted: bigint, inserted: string>>"


class Counter:
    """Tokens of pre-tokens; two generations are remembered, long ones for the text at hand only."""

    def __init__(self, vocabulary: Vocabulary):
        self.coder, self.known, self.older = Coder(vocabulary), {}, {}

    def count(self, pretokens: list[str]) -> list[int]:
        if len(self.known) > REMEMBER:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        new = list(set(pretokens).difference(known))
        if new:
            known.update((p, older[p]) for p in new if p in older)
            new = [p for p in new if p not in known]
            known.update(zip(new, map(len, self.coder.ids_of(new)), strict=True))
        out = [known[p] for p in pretokens]
        for p in new:
            if len(p) > SHORT:
                del known[p]
        return out


class Tree:
    """Segment tree of (characters, tokens) over the leaves of a text."""

    def __init__(self, text: str, counter: Counter, leaf: int = LEAF):
        self.text, self.counter, self.encoded, self.leaf = text, counter, 0, leaf
        self._build(self._leaves(counter.coder.find(text)) or [(0, 0)])

    def _leaves(self, pretokens: list[str], width: int | None = None) -> list[tuple[int, int]]:
        """(characters, tokens) of every ``width`` pre-tokens (a leaf's), encoded in one go."""
        width = width or self.leaf
        self.encoded += len(pretokens)
        tokens, chars = self.counter.count(pretokens), list(map(len, pretokens))
        return [(sum(chars[k : k + width]), sum(tokens[k : k + width])) for k in range(0, len(pretokens), width)]

    def _build(self, leaves: list[tuple[int, int]]) -> None:
        self.n = len(leaves)
        self.size = 1 << max(0, (self.n - 1).bit_length())
        self.chars = [0] * self.size + [c for c, _ in leaves] + [0] * (self.size - self.n)
        self.tokens = [0] * self.size + [t for _, t in leaves] + [0] * (self.size - self.n)
        for i in range(self.size - 1, 0, -1):
            self._sum(i)

    def _sum(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def find(self, position: int) -> tuple[int, int]:
        """The leaf that holds a character (the last one beyond the end) and where it begins."""
        i, begin = 1, 0
        while i < self.size:
            i *= 2
            if position >= begin + self.chars[i] and self.chars[i + 1]:
                begin += self.chars[i]
                i += 1
        return i - self.size, begin

    def edit(self, position: int, deleted: int, inserted: str) -> None:
        """Replace ``deleted`` characters at ``position``; both are held to the text."""
        position = min(max(0, position), len(self.text))
        deleted = min(max(0, deleted), len(self.text) - position)
        old_end, shift = position + deleted, len(inserted) - deleted
        ahead = self.text[:position]
        self.text = ahead + inserted + self.text[old_end:]
        first, begin = self.find(max(0, min(position - 2, len(ahead.rstrip()))))
        last, end = self.find(max(position, old_end - 1))
        end += self.chars[self.size + last]
        found, at = [], begin
        for match in self.counter.coder.pattern.finditer(self.text, begin):
            found.append(match.group())
            at = match.end()
            while last + 1 < self.n and end + shift < at:
                last += 1
                end += self.chars[self.size + last]
            if at == end + shift and end >= old_end:
                break
        else:
            last = self.n - 1
        span = last - first + 1
        if len(found) > 4 * self.leaf * span or not found and span < self.n:
            made = self._leaves(found)
            old = list(zip(self.chars[self.size : self.size + self.n], self.tokens[self.size : self.size + self.n], strict=True))
            self._build(old[:first] + made + old[last + 1 :] or [(0, 0)])  # no other leaf is encoded again
            return
        step, more = divmod(len(found), span)
        at = 0
        for k in range(span):
            width = step + (k < more)
            i = self.size + first + k
            self.chars[i], self.tokens[i] = (self._leaves(found[at : at + width], max(1, width)) or [(0, 0)])[0]
            at += width
        low, high = (self.size + first) // 2, (self.size + last) // 2
        while low:
            for i in range(low, high + 1):
                self._sum(i)
            low, high = low // 2, high // 2


def edited_counts(docs: DataFrame, vocabulary: Vocabulary, edits: str = "edits") -> DataFrame:
    """Counts of each row's text before and after its edits, in their order.

    docs has doc_id, text and an array of (position, deleted, inserted) in
    characters. Returns doc_id, n_tokens, n_edits, n_chars_after,
    n_tokens_after, n_pretokens, n_reencoded (pre-tokens encoded for the edits)
    and n_leaves. Null texts and inserts are empty, a null list has no edits,
    a null edit is left out, null numbers are 0; positions beyond the text mean
    its end. Repeated rows are counted one by one. A very long text has a tree in
    proportion to it, in the memory of its own task. Extra columns are not read.
    """
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary.ranks, vocabulary.pattern, vocabulary.model))  # as large as the vocabulary
    names = ["n_tokens", "n_edits", "n_chars_after", "n_tokens_after", "n_pretokens", "n_reencoded", "n_leaves"]

    @F.pandas_udf(", ".join(f"{n} bigint" for n in names))
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        counter = Counter(Vocabulary(*shared.value))
        with without_gc():
            for texts, edited in batches:
                out = []
                for text, todo in zip(texts, edited, strict=True):
                    tree = Tree(text or "", counter)
                    before, built = tree.total, tree.encoded
                    todo = [e for e in todo if e is not None] if todo is not None else []
                    for e in todo:
                        tree.edit(int(e["position"] or 0), int(e["deleted"] or 0), e["inserted"] or "")
                    out.append((before, len(todo), len(tree.text), tree.total, built, tree.encoded - built, tree.n))
                yield pd.DataFrame(out, columns=names)

    made = docs.select("doc_id", run("text", F.col(edits).cast(EDITS)).alias("_made"))
    return made.select("doc_id", *[F.col(f"_made.{n}").alias(n) for n in names])


def sample_edits(docs: DataFrame) -> DataFrame:
    """docs with three edits each, made from the text's length: a replacement, a deletion and an insertion."""
    return docs.withColumn("edits", F.expr("array(named_struct('position', length(text) div 3, 'deleted', 5L, 'inserted', ' revised'), named_struct('position', 2 * length(text) div 3, 'deleted', 12L, 'inserted', ''), named_struct('position', length(text) div 2, 'deleted', 0L, 'inserted', concat(' ', substr(text, 1, 9), '\\n')))"))
