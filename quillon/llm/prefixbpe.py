"""Byte-level BPE by prefix dynamic programming (operator 3).

For every prefix of a piece exactly one token can come last in the prefix's BPE encoding: the one that is
compatible with the last token of what precedes it. Storing that token for each prefix makes an append exact
(earlier entries never change) and lets an edit stop as soon as the table agrees with the old one again. Two
tokens are compatible if merging, replayed backwards along their own merge trees, finds no merge across the
boundary that would have come first.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bytelevel import LETTER, NUMBER, OTHER, SPACE, BatchEncoder, Classes, chunks, text_buffer
from .shared import ship, worker_state


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class PrefixEncoder:
    """The tables of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.longest = max(map(len, ranks))
        self.bytes = {v: k for k, v in ranks.items()}
        size = max(self.bytes) + 1
        self.left, self.right = list(range(size)), list(range(size))
        self.merges: dict[int, int] = {}
        self.known: dict[int, bool] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None and a < rank and b < rank and self._compatible(a, b):
                    self.left[rank], self.right[rank] = a, b
                    self.merges[a << 32 | b] = rank
                    break
        self.known.clear()
        #: Every ending of every token: the token that it is, or -1.
        self.suffixes = {t[k:]: -1 for t in ranks for k in range(len(t))} | ranks

    def _compatible(self, a: int, b: int) -> bool:
        """Whether BPE leaves a boundary between tokens a and b: undo the later of the merges that touch it, one at a time."""
        merges, left, right = self.merges, self.left, self.right
        bound = 1 << 62
        while True:
            merged = merges.get(a << 32 | b)
            if merged is not None and merged < bound:
                return False
            inner_a, inner_b = right[a], left[b]
            if inner_a == a and inner_b == b:
                return True
            if inner_b == b or (inner_a != a and a > b):
                bound, a = a, inner_a
            else:
                bound, b = b + 1, inner_b

    def compatible(self, a: int, b: int) -> bool:
        key = a << 32 | b
        found = self.known.get(key)
        if found is None:
            found = self._compatible(a, b)
            if len(self.known) < 2_000_000:
                self.known[key] = found
        return found

    def extend(self, piece: bytes, last: list[int], begin: int, end: int) -> None:
        """Set last[begin:end], where last[i] is the token that ends the encoding of piece[:i + 1]."""
        suffixes, known = self.suffixes, self.known
        for i in range(begin, end):
            stop, at, ending = i + 1, i, []
            while at >= 0:
                token = suffixes.get(piece[at:stop])
                if token is None:
                    break
                if token >= 0:
                    ending.append((at, token))
                at -= 1
            for at, token in reversed(ending):
                if not at:
                    break
                pair = last[at - 1] << 32 | token
                fits = known.get(pair)
                if fits or fits is None and self.compatible(last[at - 1], token):
                    break
            else:
                raise ValueError("the vocabulary lacks a single byte")
            last[i] = token

    def ids(self, last: list[int]) -> list[int]:
        out, at = [], len(last)
        while at:
            out.append(last[at - 1])
            at -= len(self.bytes[out[-1]])
        return out[::-1]

    def encode(self, piece: bytes) -> list[int]:
        """The ids of one piece. A piece that is a token itself is that token, as in the rank-based library."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        last = [0] * len(piece)
        self.extend(piece, last, 0, len(piece))
        return self.ids(last)


class PrefixTable:
    """A piece under edit: its bytes and, for each prefix, the last token."""

    def __init__(self, encoder: PrefixEncoder, piece: bytes = b""):
        self.encoder, self.piece, self.last = encoder, b"", []
        self.append(piece)

    def append(self, more: bytes) -> None:
        """Exact: entries for earlier prefixes stay as they are."""
        begin = len(self.piece)
        self.piece += more
        self.last += [0] * len(more)
        self.encoder.extend(self.piece, self.last, begin, len(self.piece))

    def replace(self, begin: int, end: int, new: bytes) -> int:
        """Put ``new`` in place of piece[begin:end]; returns how many prefixes were computed anew.

        An entry depends on the entries and bytes of one longest token before it. Once as many entries in a
        row agree with the old table, all later ones do.
        """
        old = self.last[end:]
        self.piece = self.piece[:begin] + new + self.piece[end:]
        self.last = self.last[:begin] + [0] * len(new) + old
        at, agree, longest = begin, 0, self.encoder.longest
        while at < len(self.piece) and agree < longest:
            before = self.last[at]
            self.encoder.extend(self.piece, self.last, at, at + 1)
            agree = agree + 1 if at >= begin + len(new) and before == self.last[at] else 0
            at += 1
        return at - begin

    def ids(self) -> list[int]:
        return self.encoder.ids(self.last)


class Codec:
    """Batch encoder and decoder over the prefix tables of one rank file."""

    def __init__(self, path: str):
        self.encoder = PrefixEncoder(read_ranks(path))
        tests = [(kind, regex.compile(p)) for kind, p in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s"))]
        self.batch = BatchEncoder(Classes(lambda c: next((k for k, p in tests if p.match(c)), OTHER)), lambda words: [array("I", self.encoder.encode(w)).tobytes() for w in words])
        size = max(self.encoder.bytes) + 1
        tokens = [self.encoder.bytes.get(i, b"") for i in range(size)]
        self.length = np.fromiter(map(len, tokens), np.int64, size)
        self.begin = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of ``ids`` and, for each id, where its bytes begin (one more for the end)."""
        length = self.length[ids]
        edges = np.concatenate([np.zeros(1, np.int64), np.cumsum(length)])
        take = np.repeat((self.begin[ids] - edges[:-1]).astype(np.int32), length)
        take += np.arange(edges[-1], dtype=np.int32)
        return self.flat[take], edges


def codec(path: str) -> Codec:
    return worker_state(f"ranks {path}", lambda: Codec(path))


def encode_documents(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """Encode every text by the ranks at ``path`` and decode the ids again.

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256 and, on request, ids. A null text is empty: no ids,
    both hashes those of no bytes. Repeated rows give repeated results, no documents none; other columns are not read.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = codec(path)
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for low, high in chunks(offsets):
                got = both.batch.encode(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                text, edges = both.decode(got.ids)
                hashes, decoded = [], []
                for i in range(high - low):
                    a, b = got.offsets[i], got.offsets[i + 1]
                    hashes.append(hashlib.sha256(got.ids[a:b]).hexdigest())
                    decoded.append(hashlib.sha256(text[edges[a] : edges[b]]).hexdigest())
                columns = [batch.column(0).slice(low, high - low), pa.array(np.diff(got.offsets)), pa.array(hashes), pa.array(decoded)]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(got.offsets, pa.int32()), pa.array(got.ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    fields = [T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    return docs.select("doc_id", "text").mapInArrow(run, T.StructType(fields))
