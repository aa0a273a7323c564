"""Byte-level BPE encoding and decoding with the tokenizers library, over Arrow batches.

A text is split by the vocabulary's pattern; each distinct piece of a batch is encoded once by the library's BPE
model, since most pieces recur. Ids, and the bytes that they decode to, are put together from tables of arrays.
Byte-level vocabularies write each byte as a printable character; decoding reverses that table. A token can end
within a character, so offsets are found on bytes and then carried over to characters.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer, pre_tokenizers

from spoor.llm.tokens import buffers, slices
from spoor.llm.workers import streaming

VOCABULARY = "byte_bpe_50k.json"
#: Pieces that a codec remembers before it starts anew: bounds a worker's memory.
REMEMBERED = 100_000
#: Pieces that the library encodes at a time.
LEARNED = 10_000
#: Pieces that are handled at a time, also of one text.
AT_A_TIME = 250_000


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if printable, else the next one from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, free = [], 0x100
    for byte in range(256):
        out.append(chr(byte if byte in shown else free))
        free += byte not in shown
    return out


class Codec:
    """Encodes and decodes columns. path: a tokenizers JSON file of a byte-level BPE; pattern: what splits texts."""

    def __init__(self, path: str, pattern: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings are ordinary text
        self.tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.pattern = regex.compile(pattern)
        byte_of = {c: b for b, c in enumerate(byte_characters())}
        size = self.tokenizer.get_vocab_size()
        names = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        tokens = [bytes(byte_of[c] for c in n) if all(c in byte_of for c in n) else n.encode() for n in names]
        self.token_bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.token_size = np.array([len(t) for t in tokens], dtype=np.int64)
        self.token_start = np.cumsum(self.token_size) - self.token_size
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.piece_size = np.zeros(0, dtype=np.int64)
        self.piece_start = np.zeros(0, dtype=np.int64)
        self.piece_ids = np.zeros(0, dtype=np.uint32)

    def _learn(self, fresh: list[str]) -> None:
        parts, sizes = [self.piece_ids], []
        for at in range(0, len(fresh), LEARNED):
            some = fresh[at : at + LEARNED]
            found = self.tokenizer.encode(some, is_pretokenized=True, add_special_tokens=False)
            parts.append(np.array(found.ids, dtype=np.uint32))
            sizes.append(np.bincount(np.array(found.word_ids, dtype=np.int64), minlength=len(some)))
        size = np.concatenate(sizes)
        start = len(self.piece_ids) + np.cumsum(size) - size
        self.piece_start = np.concatenate([self.piece_start, start])
        self.piece_size = np.concatenate([self.piece_size, size])
        self.piece_ids = np.concatenate(parts)
        self.known.update(zip(fresh, range(len(self.known), len(self.known) + len(fresh)), strict=True))

    def _which(self, pieces: list[str]) -> np.ndarray:
        """The number of each piece; those that are new are learned."""
        fresh = [p for p in dict.fromkeys(pieces) if p not in self.known]
        if fresh and self.known and len(self.known) + len(fresh) > REMEMBERED:
            self.forget()
            fresh = list(dict.fromkeys(pieces))
        if fresh:
            self._learn(fresh)
        return np.fromiter(map(self.known.__getitem__, pieces), dtype=np.int64, count=len(pieces))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids, one after the other, and the number of ids of each. A null counts as empty."""
        parts, sizes, waiting, owners = [], np.zeros(len(texts), dtype=np.int64), [], []

        def flush() -> None:
            if not waiting:
                return
            which = self._which(waiting)
            size = self.piece_size[which]
            parts.append(gather(self.piece_ids, self.piece_start[which], size))
            upto = np.r_[0, np.cumsum(size)][np.cumsum([n for _, n in owners])]
            np.add.at(sizes, [row for row, _ in owners], np.diff(upto, prepend=0))
            waiting.clear()
            owners.clear()

        for row, text in enumerate(texts):
            if not text:
                continue
            found = (m.group() for m in self.pattern.finditer(text)) if len(text) > AT_A_TIME else None
            while pieces := list(islice(found, AT_A_TIME)) if found else self.pattern.findall(text):
                waiting += pieces
                owners.append((row, len(pieces)))
                if len(waiting) >= AT_A_TIME:
                    flush()
                if not found:
                    break
        flush()
        return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint32), sizes

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids, as they are: an id may begin or end within a character."""
        return gather(self.token_bytes, self.token_start[ids], self.token_size[ids])

    def decoded(self, ids: np.ndarray, cuts: np.ndarray) -> pa.Array:
        """The bytes of each run of ids ``cuts[i] : cuts[i + 1]``."""
        return _binaries(self.decode(ids), np.r_[0, np.cumsum(self.token_size[ids])][cuts])

    def offsets(self, ids: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and one past the last character of each id of one text; a split character counts for all its ids."""
        stop = np.cumsum(self.token_size[ids])
        begin = stop - self.token_size[ids]
        character = np.cumsum((data & 0xC0) != 0x80) - 1
        return character[begin], character[stop - 1] + 1


def gather(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``values[start[0] : start[0] + size[0]]``, then the next range, and so on."""
    if not len(start):
        return values[:0]
    before = np.cumsum(size) - size
    return values[np.repeat(start - before, size) + np.arange(int(size.sum()))]


def codec(path: str, pattern: str) -> Codec:
    """One codec for each worker process."""
    kept = sys.__dict__.setdefault("_spoor_codecs", {})
    if (path, pattern) not in kept:
        kept[path, pattern] = Codec(path, pattern)
    return kept[path, pattern]


def _struct_of(df: DataFrame, but: set[str]) -> tuple[list[str], object]:
    rest = [c for c in df.columns if c not in but]
    return rest, F.struct(*[F.col(f"`{c}`") for c in rest] or [F.lit(0).alias("none")])


def _mapped(df: DataFrame, column: str, new: list[T.StructField], work) -> DataFrame:
    """``df`` with the columns ``new`` made from one column; they replace columns of the same names."""
    rest, others = _struct_of(df, {f.name for f in new})
    frame = df.select(F.col(f"`{column}`").alias("it"), others.alias("rest"))
    schema = T.StructType([*(T.StructField(f"new{i}", f.dataType) for i, f in enumerate(new)), frame.schema["rest"]])

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for row, rows in slices(batch.column(0)):
                part = batch.slice(row, rows)
                made = work(part.column(0))
                yield pa.RecordBatch.from_arrays([*made, part.column(1)], [f.name for f in schema])
        for own in sys.__dict__.get("_spoor_codecs", {}).values():
            own.forget()  # the worker lives on

    out = frame.mapInArrow(streaming(batches), schema)
    return out.select(
        *[F.col(f"rest.`{c}`").alias(c) for c in rest], *[F.col(f"new{i}").alias(f.name) for i, f in enumerate(new)]
    )


def encode(
    df: DataFrame, *, text: str = "text", offsets: bool = False, decoded: bool = False, path: str | None = None,
    pattern: str = public_tokenizers.PATTERN,
) -> DataFrame:
    """``df`` with ``n_tokens`` long and ``ids`` binary (unsigned 32-bit little-endian) of a text column.

    offsets : also ``starts`` and ``ends``, arrays of the first character of each id and the one after its last
    decoded : also ``decoded`` binary, which the ids are turned back into in the same pass, as :func:`decode` does
    path    : a byte-level vocabulary in the tokenizers format, readable on every executor

    A null or empty text has no ids. Special tokens' strings are ordinary text. A text of any length is encoded
    whole, some pieces at a time. Columns of these names in ``df`` are replaced; rows keep their number.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    new = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())]
    if offsets:
        new += [T.StructField(n, T.ArrayType(T.LongType())) for n in ("starts", "ends")]
    if decoded:
        new.append(T.StructField("decoded", T.BinaryType()))

    def work(column: pa.Array) -> list[pa.Array]:
        own = codec(path, pattern)
        ids, sizes = own.encode(column.to_pylist())
        cuts = np.r_[0, np.cumsum(sizes)]
        out = [pa.array(sizes, pa.int64()), _binaries(ids.astype("<u4").view(np.uint8), cuts * 4)]
        if offsets:
            data, where = buffers(column)
            pairs = [
                own.offsets(ids[a:z], data[b:y])
                for a, z, b, y in zip(cuts[:-1], cuts[1:], where[:-1], where[1:], strict=True)
            ]
            for side in (0, 1):
                flat = np.concatenate([p[side] for p in pairs]) if pairs else np.zeros(0, dtype=np.int64)
                out.append(pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(flat, pa.int64())))
        if decoded:
            out.append(own.decoded(ids, cuts))
        return out

    return _mapped(df, text, new, work)


def decode(
    df: DataFrame, *, ids: str = "ids", path: str | None = None, pattern: str = public_tokenizers.PATTERN
) -> DataFrame:
    """``df`` with ``decoded`` binary: the bytes of the ids of a column as :func:`encode` makes it; null: none.

    Bytes, not text, since ids that were cut out of a text may begin or end within a character.
    """
    path = path or public_tokenizers.path(VOCABULARY)

    def work(column: pa.Array) -> list[pa.Array]:
        own = codec(path, pattern)
        column = column.cast(pa.large_binary()).fill_null(b"")
        _, where, data = column.buffers()
        cuts = np.frombuffer(where, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
        raw = np.frombuffer(data, dtype=np.uint8)[cuts[0] : cuts[-1]] if data is not None else np.zeros(0, np.uint8)
        return [own.decoded(np.ascontiguousarray(raw).view("<u4"), (cuts - cuts[0]) // 4)]

    return _mapped(df, ids, [T.StructField("decoded", T.BinaryType())], work)


def _binaries(data: np.ndarray, cuts: np.ndarray) -> pa.Array:
    data = np.ascontiguousarray(data)
    return pa.Array.from_buffers(
        pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())]
    )


def op7_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Digests of the ids of every text of ``documents`` and of the bytes that they decode to."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = encode(docs, decoded=True)
    return out.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
