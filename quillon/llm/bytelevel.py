"""Byte-level BPE over whole batches: vectorised pre-tokenisation and an encoder applied once per distinct word.

The pre-tokens of the public byte-level pattern tile a text without gaps, so a batch of texts needs only the
byte offsets at which pre-tokens start. Arrow then dictionary-encodes the words without copying the text, and
the encoder sees each distinct word once per batch; a bounded cache keeps words between batches.
"""

from __future__ import annotations

import codecs
import re
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

LETTER, NUMBER, OTHER, SPACE, UNKNOWN = 0, 1, 2, 3, 9
#: Bytes of text that are handled at once. A single longer text is handled alone.
CHUNK_BYTES = 8 << 20
#: Words kept between batches; later words are encoded anew when it is full, so memory is bounded and results do not change.
CACHE_WORDS = 600_000


class Classes:
    """The class of each code point, asked of ``probe`` when first met."""

    def __init__(self, probe: Callable[[str], int]):
        self.probe = probe
        self.table = np.full(0x110000, UNKNOWN, np.uint8)
        self.ascii = bytes([probe(chr(c)) for c in range(128)] + [OTHER] * 128)

    def of(self, points: np.ndarray) -> np.ndarray:
        found = self.table[points]
        if (found == UNKNOWN).any():
            for c in np.unique(points[found == UNKNOWN]).tolist():
                self.table[c] = self.probe(chr(c))
            found = self.table[points]
        return found

    def of_bytes(self, data: np.ndarray) -> np.ndarray:
        """The class of the character that each byte of UTF-8 ``data`` belongs to."""
        kind = np.frombuffer(bytearray(data.tobytes().translate(self.ascii)), np.uint8)
        lead = np.flatnonzero(data >= 0xC0)
        if len(lead):
            size = np.where(data[lead] >= 0xF0, 4, np.where(data[lead] >= 0xE0, 3, 2))
            for width, mask in ((2, 0x1F), (3, 0x0F), (4, 0x07)):
                at = lead[size == width]
                if len(at):
                    point = data[at].astype(np.int64) & mask
                    for k in range(1, width):
                        point = point << 6 | (data[at + k].astype(np.int64) & 0x3F)
                    found = self.of(point)
                    for k in range(width):
                        kind[at + k] = found
        return kind


def word_starts(data: np.ndarray, doc_offsets: np.ndarray, classes: Classes) -> np.ndarray:
    """Byte offsets where pre-tokens start, ascending, for UTF-8 ``data`` cut into texts at ``doc_offsets``.

    Follows the public pattern ('s 't 're 've 'm 'll 'd, an optional space before letters, numbers or other
    characters, white space that leaves its last character to what follows). Empty texts have no pre-token.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes.of_bytes(data)
    first = np.zeros(n + 1, bool)
    first[doc_offsets] = True
    first[n] = True
    start = first[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    # the last character of a white-space run that something follows in the same text
    space = kind == SPACE
    last = np.flatnonzero(space[:-1] & ~space[1:] & ~first[1:n]) if n > 1 else np.zeros(0, np.int64)
    wide = data[last] >= 0x80
    begin = last.copy()
    if wide.any():
        for _ in range(3):
            begin = np.where((data[begin] & 0xC0) == 0x80, begin - 1, begin)
    start[begin] = True
    joined = last[data[last] == 0x20]
    start[joined + 1] = False
    # contractions: an apostrophe that starts a pre-token and is the whole run of other characters
    quote = np.flatnonzero((data == 0x27) & start)
    if len(quote):
        padded = np.concatenate([data, np.zeros(4, np.uint8)])
        ends = np.concatenate([first, np.ones(4, bool)])
        one = padded[quote + 1]
        two = padded[quote + 2]
        inside = ~ends[quote + 1]
        single = inside & np.isin(one, np.frombuffer(b"stmd", np.uint8))
        pair = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        double = inside & ~ends[quote + 2] & pair
        at = quote[single]
        start[at + 1] = False
        start[(at + 2)[at + 2 < n]] = True
        at = quote[double]
        start[at + 1] = False
        start[(at + 3)[at + 3 < n]] = True
    return np.flatnonzero(start)


@dataclass
class Encoded:
    """Ids of a run of texts: those of text i are ids[offsets[i]:offsets[i + 1]]."""

    ids: np.ndarray
    offsets: np.ndarray


class BatchEncoder:
    """Encodes Arrow string arrays. ``encode_word`` maps a pre-token's bytes to its ids as little-endian uint32 bytes.

    ``added`` has strings that are one id wherever a text holds them; what is between them is encoded as texts of their own.
    """

    def __init__(self, classes: Classes, encode_words: Callable[[list[bytes]], list[bytes]], cache_words: int = CACHE_WORDS, added: dict[bytes, int] | None = None):
        self.classes, self.encode_words, self.cache_words = classes, encode_words, cache_words
        self.cache: dict[bytes, bytes] = {k: array("I", [v]).tobytes() for k, v in (added or {}).items()}
        self.added = re.compile(b"|".join(re.escape(k) for k in sorted(added, key=len, reverse=True))) if added else None

    def spans(self, data: np.ndarray, doc_offsets: np.ndarray) -> np.ndarray:
        """Begin and end of the added strings, leftmost and longest first; none reaches from one text into the next."""
        out, at, raw = [], 0, data.tobytes() if self.added else b""
        while self.added and (m := self.added.search(raw, at)):
            text_end = int(doc_offsets[np.searchsorted(doc_offsets, m.start(), side="right")])
            inside = m if m.end() <= text_end else self.added.match(raw, m.start(), text_end)
            at = inside.end() if inside else m.start() + 1
            if inside:
                out.append(inside.span())
        return np.array(out, np.int64).reshape(-1, 2)

    def words(self, values: list[bytes]) -> list[bytes]:
        get = self.cache.get
        found = [get(v) for v in values]
        if None in found:
            missing = [k for k, v in enumerate(found) if v is None]
            new = self.encode_words([values[k] for k in missing])
            for k, v in zip(missing, new, strict=True):
                found[k] = v
                if len(self.cache) < self.cache_words and len(values[k]) <= 64:
                    self.cache[values[k]] = v
        return found

    def encode(self, data: np.ndarray, doc_offsets: np.ndarray) -> Encoded:
        """data: UTF-8 bytes of the texts one after another; doc_offsets: n + 1 offsets."""
        edges = doc_offsets[:-1][np.diff(doc_offsets) > 0]
        spans = self.spans(data, doc_offsets)
        if len(spans):
            edges = np.union1d(edges, spans)
        starts = word_starts(data, edges, self.classes)
        if len(spans):
            held = np.searchsorted(spans[:, 0], starts, side="left") - 1  # the last span that begins before
            starts = starts[(held < 0) | (starts >= spans[held, 1])]
        if not len(starts):
            return Encoded(np.zeros(0, np.uint32), np.zeros(len(doc_offsets), np.int64))
        edges = np.append(starts, len(data)).astype(np.int64)
        array = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(data)])
        coded = array.dictionary_encode()
        index = coded.indices.to_numpy()
        found = self.words(coded.dictionary.to_pylist())
        flat = np.frombuffer(b"".join(found), np.uint32)
        length = np.fromiter(map(len, found), np.int64, len(found)) >> 2
        begin = np.cumsum(length) - length
        count = length[index]
        total = np.concatenate([np.zeros(1, np.int64), np.cumsum(count)])
        narrow = np.int32 if max(total[-1], len(flat)) < 2**31 else np.int64
        take = np.repeat((begin[index] - total[:-1]).astype(narrow), count)
        take += np.arange(total[-1], dtype=narrow)
        at = np.searchsorted(starts, doc_offsets, side="left")
        return Encoded(flat[take], total[at])


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and n + 1 offsets of a string column, nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(column) and column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES, rows: int = 1 << 30) -> Iterator[tuple[int, int]]:
    """Ranges of at most ``rows`` texts that hold at most ``most`` bytes together, or one longer text."""
    begin, n = 0, len(offsets) - 1
    while begin < n:
        end = max(begin + 1, min(begin + rows, int(np.searchsorted(offsets, offsets[begin] + most, side="right")) - 1))
        yield begin, min(end, n)
        begin = min(end, n)


def byte_letters() -> str:
    """The letter that stands for each byte value in byte-level vocabularies: printable ones for themselves, others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    shown = set(printable)
    return "".join(chr(b) if b in shown else chr(next(rest)) for b in range(256))


_LETTERS = byte_letters()
_PARTED = "\x00" + _LETTERS[1:]


def library_encoder(path: str, cache_words: int = CACHE_WORDS, added_tokens: bool = False) -> BatchEncoder:
    """Ids as the tokenizers library gives them for the byte-level JSON file at ``path``, without special tokens around a text.

    Each distinct pre-token goes through the library's model. With ``added_tokens`` the strings of the file's added tokens
    are their ids, as in the library; without, they are ordinary text, as with its ``encode_special_tokens``.
    """
    from tokenizers import Tokenizer, pre_tokenizers

    library = Tokenizer.from_file(path)
    model = library.model
    added = library.get_added_tokens_decoder() if added_tokens else {}
    if any(t.single_word or t.lstrip or t.rstrip for t in added.values()):
        raise ValueError("added tokens that depend on what is around them are not supported")
    split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)

    def pieces(text: str) -> int:
        return len(split.pre_tokenize_str(text))

    def probe(c: str) -> int:
        return next((kind for kind, x in ((LETTER, "a"), (NUMBER, "1"), (OTHER, ".")) if pieces(x + c + x) == 1), SPACE)

    def encode_words(words: list[bytes]) -> list[bytes]:
        # one decoding for all words; NUL parts them, and a word that has NUL itself is decoded alone
        text = codecs.charmap_decode(b"\x00".join(words), "strict", _PARTED)[0].split("\x00")
        if len(text) != len(words):
            text = [codecs.charmap_decode(w, "strict", _LETTERS)[0] for w in words]
        tokenize = model.tokenize
        return [array("I", [t.id for t in tokenize(w)]).tobytes() for w in text]

    return BatchEncoder(Classes(probe), encode_words, cache_words, {t.content.encode(): i for i, t in added.items()})


def letter_classes() -> Classes:
    """Letters against everything else, by the Unicode property."""
    return Classes(lambda c: LETTER if c.isalpha() else OTHER)


def letter_runs(data: np.ndarray, offsets: np.ndarray, classes: Classes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words (runs of letters) of a run of texts: distinct words, the word at each place, and where each text's begin (n + 1)."""
    n = len(data)
    if not n:
        return pa.array([], pa.large_binary()), np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
    kind = classes.of_bytes(data)
    start = np.empty(n, bool)
    start[0] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    start[offsets[:-1][np.diff(offsets) > 0]] = True
    starts = np.flatnonzero(start)
    coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, n)), pa.py_buffer(data)]).dictionary_encode()
    word = kind[starts] == LETTER
    return coded.dictionary, coded.indices.to_numpy()[word], np.searchsorted(starts[word], offsets, side="left")
