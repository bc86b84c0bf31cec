"""Byte-level BPE through a sentencepiece model serialised from the vocabulary.

Every byte of a token is mapped to one printable character; the tokens become
the pieces of a sentencepiece BPE model, scored by their negative ranks, with
identity normalisation. Texts are cut into pre-tokens, each is encoded by the
model, and ids are decoded by the inverse mapping. The model is as large as the
vocabulary, so it is broadcast.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.llm.runtime import clear_of, fresh, text_batches, without_gc

#: One character for each byte, none of them white space or sentencepiece's own mark.
BYTE_CHARS = [chr(0x4E00 + b) for b in range(256)]
_TO_CHARS = dict(enumerate(BYTE_CHARS))
#: Pre-tokens that a generation of the memory of a coder holds (two are kept), and the letters of the longest of them.
CACHE, SHORT = 75_000, 200


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _bytes_field(number: int, value: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def _int_field(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto: piece 0 is the unknown one, piece k + 1 the token of the k-th rank."""
    piece = lambda text, score, kind: _bytes_field(1, _bytes_field(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _int_field(3, kind))
    body = [piece("<unk>", 0.0, 2)]
    body += [piece("".join(BYTE_CHARS[b] for b in token), -float(rank), 1) for token, rank in sorted(ranks.items(), key=lambda x: x[1])]
    trainer = _int_field(3, 2) + _int_field(4, len(ranks) + 1) + _int_field(40, 0) + b"".join(_varint(n << 3) + _varint((1 << 64) - 1) for n in (41, 42, 43))  # BPE; <unk> is 0, no <s>, </s>, <pad>
    normaliser = _bytes_field(1, b"identity") + _int_field(3, 0) + _int_field(4, 0) + _int_field(5, 0)  # no prefix, no white space removed or escaped
    return b"".join(body) + _bytes_field(2, trainer) + _bytes_field(3, normaliser)


@dataclass(frozen=True)
class Vocabulary:
    """Ranks by token, the pattern of pre-tokens and the serialised model."""

    ranks: dict[bytes, int]
    pattern: str
    model: bytes

    @classmethod
    def load(cls, path: str, pattern: str) -> Vocabulary:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        return cls(ranks, pattern, serialise(ranks))


def forget(memory: dict, new: list[str]) -> None:
    """Long pre-tokens leave the memory with the slice of text they came in, so that its entries are bounded in bytes as in number."""
    for p in new:
        if len(p) > SHORT:
            del memory[p]


class Coder:
    """Encodes and decodes on one executor.

    What it remembers is bounded: 2 CACHE and as many lists of pre-tokens of
    SHORT letters at most.
    """

    def __init__(self, vocabulary: Vocabulary):
        import regex
        import sentencepiece

        self.pattern = regex.compile(vocabulary.pattern)
        self.find = self.pattern.findall
        self.ranks = vocabulary.ranks
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=vocabulary.model)
        self.order = sorted(vocabulary.ranks.values())
        self.tokens = {rank: token for token, rank in vocabulary.ranks.items()}
        self.known: dict[str, tuple[int, bytes, bytes]] = {}
        self.older: dict[str, tuple[int, bytes, bytes]] = {}
        self.lists: dict[str, list[int]] = {}

    def ids_of(self, pretokens: list[str]) -> list[list[int]]:
        """The ids of each pre-token; one that is a token needs no merges."""
        raw = [p.encode("utf-8", "surrogatepass") for p in pretokens]
        whole = [self.ranks.get(r) for r in raw]
        rest = [r.decode("latin-1").translate(_TO_CHARS) for r, w in zip(raw, whole, strict=True) if w is None]
        merged = iter(self.pieces.encode(rest, num_threads=1) if rest else [])
        order = self.order
        return [[order[i - 1] for i in next(merged)] if w is None else [w] for w in whole]

    def encode(self, text: str) -> list[int]:
        """The ids of a text; those of pre-tokens of up to SHORT letters are remembered."""
        found, lists, out = self.find(text), self.lists, []
        if len(lists) > 2 * CACHE:
            lists.clear()
        for k in range(0, len(found), 20_000):
            part = found[k : k + 20_000]
            new = [p for p in dict.fromkeys(part) if p not in lists]
            if new:
                lists.update(zip(new, self.ids_of(new), strict=True))
            out.extend(chain.from_iterable([lists[p] for p in part]))
            forget(lists, new)
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.tokens[i] for i in ids])

    def learn(self, pretokens: list[str]) -> None:
        """Number of tokens, ids as text and decoded bytes of pre-tokens, until they are forgotten."""
        older, new = self.older, []
        for p in pretokens:
            if p in older:
                self.known[p] = older[p]
            else:
                new.append(p)
        for p, ids in zip(new, self.ids_of(new), strict=True):
            self.known[p] = (len(ids), ",".join(map(str, ids)).encode(), self.decode(ids))

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of tokens, SHA-256 of the ids joined by commas and of the decoded bytes.

        Long texts go in slices of pre-tokens, so that memory stays bounded.
        """
        ids, decoded, n = hashlib.sha256(), hashlib.sha256(), 0
        found = self.find(text)
        for k in range(0, len(found), 20_000):
            part = found[k : k + 20_000]
            if len(self.known) > CACHE:
                self.known, self.older = {}, self.known
            new = [p for p in dict.fromkeys(part) if p not in self.known]
            if new:
                self.learn(new)
            known = self.known
            made = [known[p] for p in part]
            n += sum([m[0] for m in made])
            ids.update((b"," if k else b"") + b",".join([m[1] for m in made]))
            decoded.update(b"".join([m[2] for m in made]))
            forget(known, new)
        return n, ids.hexdigest(), decoded.hexdigest()


def _over_texts(docs: DataFrame, vocabulary: Vocabulary, of, schema: str) -> DataFrame:  # noqa: ANN001
    """Columns that ``of`` (coder, text) makes, beside all those of docs but the text itself.

    Only the text goes through Python; columns of docs with the new names are replaced.
    """
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary.ranks, vocabulary.pattern, vocabulary.model))  # as large as the vocabulary, whatever the input
    names = [x.split()[0] for x in schema.split(", ")]

    @F.pandas_udf(schema)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        coder = Coder(Vocabulary(*shared.value))
        with without_gc():
            for texts in batches:
                yield pd.DataFrame([of(coder, t if isinstance(t, str) else "") for t in texts], columns=names)

    rest, made = clear_of(docs, "text", *names), fresh(docs, "_coded")
    kept = [F.col(f"`{c}`") for c in rest.columns]
    return docs.select(*kept, run("text").alias(made)).select(*kept, *[F.col(f"{made}.{n}").alias(n) for n in names])


def token_digests(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row.

    Null texts count as empty: no tokens and the digests of the empty string.
    Repeated rows come out as often as they come in; extra columns are not
    read; an empty table gives no rows.
    """
    return _over_texts(docs.select("doc_id", "text"), vocabulary, Coder.digest, "n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id and ids (array<int>) of each row."""
    return _over_texts(docs.select("doc_id", "text"), vocabulary, lambda coder, text: (coder.encode(text),), "ids array<int>")


def encode_rows(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """docs without the text, with n_tokens, ids and decoded_sha256 (of the bytes that the ids decode to).

    Columns of docs with these three names are replaced.
    """

    def of(coder: Coder, text: str) -> tuple[int, list[int], str]:
        ids = coder.encode(text)
        return len(ids), ids, hashlib.sha256(coder.decode(ids)).hexdigest()

    return _over_texts(docs, vocabulary, of, "n_tokens bigint, ids array<int>, decoded_sha256 string")


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id and bytes of rows (doc_id, ids); null ids give empty bytes."""
    shared = encoded.sparkSession.sparkContext.broadcast((vocabulary.ranks, vocabulary.pattern, vocabulary.model))

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = Coder(Vocabulary(*shared.value))
        for ids in batches:
            yield pd.Series([b"" if i is None else coder.decode(i.tolist()) for i in ids], dtype=object)

    return encoded.select("doc_id", run("ids").alias("bytes"))
