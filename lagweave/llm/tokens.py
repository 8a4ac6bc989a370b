"""Encoding of whole corpora with public tokenizers, and back.

Arrow batches go through the tokenizers library in slices of bounded size. For byte-level vocabularies the table from bytes to
the characters that stand for them is rebuilt from its rule; token lengths in bytes follow, and from these the place of each
token in the text: a token that holds part of a character spans that whole character. Decoding reverses the table and joins
bytes before reading characters, so split characters come out whole.

The folder of the vocabulary files is a parameter and must exist on every executor; nothing of it is copied.
"""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

FOLDER = "/opt/tokenizers"
#: Texts and characters of one call of the library; a single longer text is a slice of its own, whole.
SLICE_TEXTS, SLICE_CHARS = 512, 1_000_000
#: Fixed value: the pattern that splits texts before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_table() -> dict[str, int]:
    """Character to byte of byte-level vocabularies: bytes with a visible Latin-1 character stand for themselves, the others for 256, 257, ... in order."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


@functools.lru_cache(maxsize=8)
def encoder(folder: str, name: str):
    """A function from texts to lists of ids, for the vocabulary of that name; special strings are ordinary text and none are added."""
    path = os.path.join(folder, name)
    if os.path.exists(path + ".json"):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the tasks are the parallelism
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path + ".json")
        t.encode_special_tokens = True
        return lambda texts: [e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)]
    if os.path.exists(path + ".tiktoken"):
        import tiktoken

        with open(path + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        e = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [e.encode_ordinary(x) for x in texts]
    if os.path.exists(path + ".model"):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path + ".model")
        return lambda texts: p.encode(texts, num_threads=1)
    raise FileNotFoundError(f"no vocabulary {name} in {folder}")


@functools.lru_cache(maxsize=4)
def token_bytes(folder: str, name: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary (a .json file)."""
    from tokenizers import Tokenizer

    t, back = Tokenizer.from_file(os.path.join(folder, name + ".json")), byte_table()
    special = {i: a.content.encode() for i, a in t.get_added_tokens_decoder().items()}
    return [special[i] if i in special else bytes(back[c] for c in t.id_to_token(i)) for i in range(t.get_vocab_size())]


def slices(texts: list[str]) -> Iterator[list[str]]:
    part, chars = [], 0
    for x in texts:
        if part and (len(part) == SLICE_TEXTS or chars + len(x) > SLICE_CHARS):
            yield part
            part, chars = [], 0
        part.append(x)
        chars += len(x)
    if part:
        yield part


def _encode(folder: str, name: str, text: str, spans: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(folder, name)
        sizes = np.array([len(b) for b in token_bytes(folder, name)]) if spans else None
        for batch in batches:
            texts = [x or "" for x in batch.column(text).to_pylist()]
            start = 0
            for part in slices(texts):
                ids = encode(part)
                rest = batch.slice(start, len(part))
                start += len(part)
                ends = np.r_[0, np.cumsum([len(i) for i in ids])].astype(np.int32)
                flat = np.fromiter((x for i in ids for x in i), np.int32, int(ends[-1]))
                cols = [*(rest.column(c) for c in rest.schema.names if c != text), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
                names = [*(c for c in rest.schema.names if c != text), "ids"]
                if spans:
                    for side, values in zip(("starts", "ends"), _places(part, ids, sizes)):
                        cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(values)))
                        names.append(side)
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def _places(texts: list[str], ids: list[list[int]], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character, and the one after the last, of each token."""
    starts, ends = [], []
    for text, own in zip(texts, ids):
        raw = np.frombuffer(text.encode(), np.uint8)
        char = np.cumsum((raw & 0xC0) != 0x80) - 1  # the character of each byte
        to = np.cumsum(sizes[own]) if own else np.zeros(0, np.int64)
        starts.append(char[to - sizes[own]] if own else to)
        ends.append(char[to - 1] + 1 if own else to)
    join = lambda parts: np.concatenate(parts).astype(np.int32) if parts else np.zeros(0, np.int32)
    return join(starts), join(ends)


def encode_texts(df: DataFrame, row_id: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str = FOLDER, spans: bool = False) -> DataFrame:
    """row_id, ids: the ids of each text, without special tokens; NULL and empty texts have an empty list. Row for row, no shuffle.

    spans (byte-level vocabularies in .json): adds starts and ends, the characters (code points) that each token covers.
    Rows with the same or a NULL row_id each come out; other columns are not read.
    """
    rows = df.select(row_id, text)
    ints = ArrayType(IntegerType())
    schema = StructType([rows.schema[row_id], StructField("ids", ints), *(StructField(n, ints) for n in ("starts", "ends") if spans)])
    return rows.mapInArrow(_encode(folder, name, text, spans), schema)


def decode_ids(df: DataFrame, row_id: str = "doc_id", ids: str = "ids", name: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """row_id, text from ids of a byte-level vocabulary. Bytes that are no whole character come out as U+FFFD; NULL ids as NULL text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(folder, name)
        for batch in batches:
            texts = [None if x is None else b"".join(table[i] for i in x).decode("utf-8", "replace") for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(row_id), pa.array(texts, pa.string())], names=[row_id, "text"])

    rows = df.select(row_id, ids)
    return rows.mapInArrow(run, StructType([rows.schema[row_id], StructField("text", StringType())]))


def count_tokens(df: DataFrame, names: list[str], row_id: str = "doc_id", text: str = "text", folder: str = FOLDER) -> DataFrame:
    """row_id, tokenizer, size: tokens of each text under each vocabulary; 0 for NULL and empty texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = [(n, encoder(folder, n)) for n in names]
        for batch in batches:
            texts = [x or "" for x in batch.column(text).to_pylist()]
            for name, encode in encoders:
                sizes = [len(i) for part in slices(texts) for i in encode(part)]
                yield pa.RecordBatch.from_arrays([batch.column(row_id), pa.array([name] * len(sizes), pa.string()), pa.array(sizes, pa.int64())], names=[row_id, "tokenizer", "size"])

    rows = df.select(row_id, text)
    return rows.mapInArrow(run, StructType([rows.schema[row_id], StructField("tokenizer", StringType()), StructField("size", LongType())]))
