"""Exact token ids of whole texts, with the chunks that recur looked up instead of encoded again.

Both tokenizers here cut a text into pieces by a pattern and encode each piece by itself. A batch of texts is cut into chunks where a
piece begins for certain: before white space (a single space goes into the byte tokenizer's piece, and means nothing to the word
tokenizer), after a newline, and between ASCII letters, digits and other signs, which no piece mixes unless it has an apostrophe.
The batch's different chunks are found by Arrow's dictionary encoding and looked up among those remembered, which are Arrow arrays, the
last used first, so that memory is bounded; a new chunk is cut by the pattern and goes to the tokenizer's own model.
Chunks with control characters or any past Latin Extended-A go to the tokenizer as they are, and so do whole texts for the byte
tokenizer where they have runs of white space of other kinds. Special tokens' strings in a text are ordinary text.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import zlib
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import SparkSession

from .common import kept_by_worker

#: Chunks remembered, each of up to LONGEST bytes, and pieces of those that hold several in a generation.
REMEMBERED = 400_000
LONGEST = 48
PIECES = 50_000
#: Chunks that are looked up at once.
AT_ONCE = 1 << 20
#: The pieces of the two tokenizers: fixed values, given by their files.
WORD_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BYTE_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Kinds of bytes by which texts are cut: ASCII letters, digits, signs without the apostrophe, space, newline; 0 for all others.
LETTER, DIGIT, SIGN, SPACE, NEWLINE = range(1, 6)
KINDS = bytes(0 if not 32 <= b < 127 or b == 39 else LETTER if chr(b).isalpha() else DIGIT if chr(b).isdigit() else SIGN for b in range(256))
KINDS = KINDS[:10] + bytes([NEWLINE]) + KINDS[11:32] + bytes([SPACE]) + KINDS[33:]
#: Small letters and spaces for capitals and white space.
LOWERED = bytes(range(256)).lower().translate(bytes(32 if b in b"\t\n\x0b\x0c\r" else b for b in range(256)))
#: White space other than space and newline, as single bytes and as first bytes in UTF-8; runs of three of those two.
OTHER_SPACES = b"\t\x0b\x0c\r\x1c\x1d\x1e\x1f"
WIDE_SPACES = [b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a", b"\xe2\x80", b"\xe2\x81", b"\xe3\x80"]
RUNS = [bytes(x) for x in itertools.product(b" \n", repeat=3)]


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_characters() -> dict[int, int]:
    """Byte -> code point of the character that stands for it: itself if it prints, else the next one from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: b if b in prints else next(rest) for b in range(256)}


class Remembered(dict):
    """key -> ids as little-endian 16-bit bytes; ``make`` gives them for a new key."""

    def __init__(self, make: Callable):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key) -> bytes:
        ids = self.old.get(key)
        if ids is None:
            ids = self.make(key)
            if len(key) > LONGEST:
                return ids
        if len(self) >= PIECES:
            self.old = dict(self)
            self.clear()
        self[key] = ids
        return ids


class Encoder:
    """Texts -> ids."""

    def __init__(self, spec: str, pieces: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.encode_special_tokens = True
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids must fit 16 bits")
        self.model, self.normalizer = self.tokenizer.model, self.tokenizer.normalizer
        self.begin(pieces)

    def begin(self, pieces: str) -> None:
        import regex

        self.cut, self.table = regex.compile(pieces).findall, byte_characters()
        self.unusual = re.compile("[^\x20-\x7e\xa1-\u012f\u0131-\u017f]").search
        self.piece = Remembered(self.of_piece)
        self.chunks = self.ids = pa.array([], pa.large_binary())

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes()

    def of_piece(self, piece: str) -> bytes:
        if not piece.isascii() or piece[0] == " ":
            piece = piece.encode().decode("latin-1").translate(self.table)
        return array("H", [t.id for t in self.model.tokenize(piece)]).tobytes()

    def of_chunk(self, chunk: bytes) -> bytes:
        """A word of letters is one piece, with the space before it; the pattern cuts the rest."""
        text = chunk.decode("utf-8", "replace")
        if self.unusual(text):
            return self.whole(text)
        if self.normalizer is not None:  # up to Latin Extended-A, and without marks that combine, it only lowers case
            text = text.lower().lstrip(" ")
        if text.removeprefix(" ").isalpha():
            return self.of_piece(text)
        return b"".join(map(self.piece.__getitem__, self.cut(text)))

    def of_chunks(self, chunks: pa.Array) -> pa.Array:
        """Ids of each chunk. What is remembered afterwards are these chunks and then those before, as many as there is room for."""
        coded = chunks.dictionary_encode()
        new, old = coded.dictionary, len(self.chunks)
        at = pc.index_in(new, value_set=self.chunks).fill_null(-1).to_numpy().astype(np.int64)
        unknown = np.flatnonzero(at < 0)
        made = pa.array(map(self.of_chunk, new.take(pa.array(unknown)).to_pylist()), pa.large_binary())
        at[unknown] = old + np.arange(len(unknown))
        ids = pa.concat_arrays([self.ids, made]).take(pa.array(at))
        short = pc.less_equal(pc.binary_length(new), LONGEST)
        unused = np.ones(old, bool)
        unused[at[at < old]] = False
        self.chunks, self.ids = (pa.concat_arrays([x.filter(short), before.filter(pa.array(unused))])[:REMEMBERED] for x, before in ((new, self.chunks), (ids, self.ids)))
        return ids.take(coded.indices)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each whole text, as little-endian 16-bit bytes."""
        whole = {i: self.whole(t.decode("utf-8", "replace")) for i, t in enumerate(texts) if self.odd(t)}
        data = b"".join([b"" if i in whole else self.prepared(t) for i, t in enumerate(texts)])
        bounds = np.cumsum([0, *(0 if i in whole else len(t) for i, t in enumerate(texts))])
        kinds = np.frombuffer(data.translate(KINDS), np.uint8)
        here, last = kinds[1:], kinds[:-1]
        begins = np.ones(len(data), bool)
        begins[1:] = (here >= SPACE) | (last == NEWLINE) | ((here != last) & (here > 0) & (last > 0) & (last < SPACE))
        begins[bounds[bounds < len(data)]] = True
        starts = np.append(np.flatnonzero(begins), len(data))
        del kinds, here, last, begins
        flat, lengths = [], [np.zeros(1, np.int64)]
        for i in range(0, len(starts) - 1, AT_ONCE):
            part = starts[i : i + AT_ONCE + 1]
            found = self.of_chunks(pa.Array.from_buffers(pa.large_binary(), len(part) - 1, [None, pa.py_buffer(part), pa.py_buffer(data)]))
            flat.append(joined(found))
            lengths.append(pc.binary_length(found).to_numpy())
        ids, ends = b"".join(flat), np.cumsum(np.concatenate(lengths))
        edges = ends[np.searchsorted(starts, bounds)].tolist()
        return [whole[i] if i in whole else ids[edges[i] : edges[i + 1]] for i in range(len(texts))]


def joined(values: pa.Array) -> memoryview:
    """The bytes of all values, one after the other."""
    _, ends, data = values.buffers()
    ends = np.frombuffer(ends, np.int64)[values.offset : values.offset + len(values) + 1]
    return memoryview(data or b"")[ends[0] : ends[-1]]


class WordEncoder(Encoder):
    """For the tokenizer whose pieces hold no white space, and that lowers case first."""

    def __init__(self, spec: str):
        super().__init__(spec, WORD_PIECES)

    def odd(self, text: bytes) -> bool:
        return False

    def prepared(self, text: bytes) -> bytes:
        return text.translate(LOWERED)


class ByteEncoder(Encoder):
    """For the byte-level tokenizer that joins one space to the word after it."""

    def __init__(self, spec: str):
        super().__init__(spec, BYTE_PIECES)

    def odd(self, text: bytes) -> bool:
        return odd_space(text)

    def prepared(self, text: bytes) -> bytes:
        return text


def odd_space(text: bytes) -> bool:
    """White space whose cutting depends on more than the next space: long runs, runs at the end, other characters."""
    if len(text.translate(None, OTHER_SPACES)) < len(text) or (len(text) > 1 and text[-2:].isspace()) or any(map(text.__contains__, RUNS)):
        return True
    return not text.isascii() and any(map(text.__contains__, WIDE_SPACES)) and re.search(r"[^\S \n]", text.decode("utf-8", "replace")) is not None


def sent(spark: SparkSession, path: str) -> Broadcast:
    """The tokenizer file at a path of the driver's, some megabytes, for all executors."""
    with open(path) as f:
        return spark.sparkContext.broadcast(f.read())


def encoder(spec: str) -> Encoder:
    """The encoder of a tokenizer file's content, one per worker."""

    def make() -> Encoder:
        byte_level = json.loads(spec)["pre_tokenizer"]["type"] == "ByteLevel"
        return (ByteEncoder if byte_level else WordEncoder)(spec)

    return kept_by_worker(f"encoder:{len(spec)}:{zlib.crc32(spec.encode())}", make)


def ids_crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
