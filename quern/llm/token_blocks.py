"""Token-ID output: patched frame-of-reference blocks.

A text's token ids are cut into blocks of 128. Of each block the minimum is subtracted; the
rest is packed at the width that holds a given percentile of the values; what doesn't fit
keeps its low bits in place and its high bits in an exception list. The starts of a document's
blocks are indexed, so any block is read without the others.

A block, all little-endian: minimum (4 bytes), number of ids less one, width, number of
exceptions (1 byte each); ids at `width` bits each, least significant first, filled to whole
bytes; the exceptions' positions (1 byte each), then their high bits (4 bytes each).

Defined results: a null text has null everywhere; an empty one has no blocks and an empty
payload. Each row of the input gives one row, repeated rows repeatedly; extra columns play no
part; an empty table gives no rows. Texts of any length are encoded whole, runs of white space of
any length too. Special tokens' strings are ordinary text.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import bounded_batches

BLOCK, HEAD = 128, 7
#: Share of a block's values that its width holds.
PERCENTILE = 0.9
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the byte-level vocabularies cut texts before merging; part of their public definition.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A run of what SPLIT calls white space that its look-ahead would go through step by step, on the stack.
_LONG_BLANK = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{512,}")
_TEXTS = 64


def _parted(encode: Callable[[str], list[int]], whole: Callable[[str], list[int]]) -> Callable[[str], list[int]]:
    """encode, with long runs of white space taken out where SPLIT parts them anyway: all of a run at the text's end, else all but its last sign."""

    def run(text: str) -> list[int]:
        out, at = [], 0
        for m in _LONG_BLANK.finditer(text):
            end = m.end() if m.end() == len(text) else m.end() - 1
            out += encode(text[at : m.start()])
            out += whole(text[m.start() : end])
            at = end
        return out + encode(text[at:]) if at else encode(text)

    return run


@cache
def tokenizer(path: str) -> Callable[[str], list[int]]:
    """Token ids of a text by a .tiktoken, .json or .model vocabulary file."""
    if path.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        encode, whole = (tiktoken.Encoding(os.path.basename(path), pat_str=p, mergeable_ranks=ranks, special_tokens={}).encode_ordinary for p in (SPLIT, r"[\s\S]+"))
        return _parted(encode, whole)
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path).encode
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(path)
    loaded.encode_special_tokens = True
    return lambda text: loaded.encode(text, add_special_tokens=False).ids


def _widths(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    return np.frexp(values.astype(np.float64))[1]


def encode_blocks(ids: np.ndarray, lengths: np.ndarray, percentile: float = PERCENTILE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all documents' blocks, start of every block among them, number of blocks by document).

    ids holds the documents' ids one after the other, lengths their numbers.
    """
    blocks = -(-lengths // BLOCK)
    n_blocks = int(blocks.sum())
    if not n_blocks:
        return np.empty(0, np.uint8), np.empty(0, np.int64), blocks
    of = np.repeat(np.arange(len(lengths)), blocks)
    nth = np.arange(n_blocks) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    n = np.minimum(BLOCK, lengths[of] - nth * BLOCK)
    inside = np.arange(BLOCK) < n[:, None]
    table = np.zeros((n_blocks, BLOCK), np.uint32)
    table[inside] = ids
    low = np.where(inside, table, np.uint32(0xFFFFFFFF)).min(axis=1)
    rest = np.where(inside, table - low[:, None], np.uint32(0))
    # what is outside sorts first, as zeros
    rank = BLOCK - n + np.maximum(np.ceil(percentile * n).astype(np.int64), 1) - 1
    width = _widths(np.take_along_axis(np.sort(rest, axis=1), rank[:, None], axis=1)[:, 0])
    high = np.where(width[:, None] > 31, np.uint32(0), rest >> np.minimum(width, 31).astype(np.uint32)[:, None])
    n_high = (high > 0).sum(axis=1)
    packed = -(-n * width // 8)
    size = HEAD + packed + 5 * n_high
    start = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    out[start[:, None] + np.arange(4)] = low.astype("<u4").view(np.uint8).reshape(-1, 4)
    out[start + 4], out[start + 5], out[start + 6] = n - 1, width, n_high
    for w in np.unique(width):
        if w:
            rows = np.flatnonzero(width == w)
            bits = np.unpackbits(rest[rows].astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, count=int(w), bitorder="little")
            whole = np.packbits(bits.reshape(len(rows), -1), axis=1, bitorder="little")
            at = np.arange(whole.shape[1])
            held = at < packed[rows][:, None]
            out[(start[rows][:, None] + HEAD + at)[held]] = whole[held]
    row, pos = np.nonzero(high)
    if len(row):
        k = np.arange(len(row)) - np.repeat(np.cumsum(n_high) - n_high, n_high)
        at = start[row] + HEAD + packed[row]
        out[at + k] = pos
        out[(at + n_high[row] + 4 * k)[:, None] + np.arange(4)] = high[row, pos].astype("<u4").view(np.uint8).reshape(-1, 4)
    return out, start, blocks


def decode_block(data: bytes, start: int = 0) -> list[int]:
    """The ids of the block that begins at start."""
    low = int.from_bytes(data[start : start + 4], "little")
    n, width, n_high = data[start + 4] + 1, data[start + 5], data[start + 6]
    at = start + HEAD
    packed = int.from_bytes(data[at : at + (n * width + 7) // 8], "little")
    values = [(packed >> (i * width)) & ((1 << width) - 1) for i in range(n)]
    at += (n * width + 7) // 8
    for k in range(n_high):
        values[data[at + k]] += int.from_bytes(data[at + n_high + 4 * k : at + n_high + 4 * k + 4], "little") << width
    return [low + v for v in values]


def decode(payload: bytes, starts: list[int]) -> list[int]:
    return [x for s in starts for x in decode_block(payload, s)]


def _encoder(path: str, percentile: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path)
        for batch in batches:
            for at in range(0, batch.num_rows, _TEXTS):
                part = batch.slice(at, _TEXTS)
                texts = part.column("text").to_pylist()
                each = [np.array(encode(t), np.uint32) if t else np.empty(0, np.uint32) for t in texts]
                lengths = np.array([len(x) for x in each], np.int64)
                data, start, blocks = encode_blocks(np.concatenate(each), lengths, percentile)
                null = np.array([t is None for t in texts])
                bound = np.concatenate([[0], np.cumsum(blocks)])
                edge = np.append(start, len(data))[bound]
                begins = start - np.repeat(edge[:-1], blocks)
                payload = [None if z else data[a:b].tobytes() for z, a, b in zip(null, edge, edge[1:])]
                index = [None if z else begins[a:b].astype(np.int32) for z, a, b in zip(null, bound, bound[1:])]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(lengths, pa.int64(), mask=null), pa.array(blocks, pa.int32(), mask=null), pa.array(index, pa.list_(pa.int32())), pa.array(payload, pa.binary())],
                    names=["doc_id", "n_tokens", "n_blocks", "block_starts", "payload"],
                )

    return run


def encode(docs: DataFrame, tokenizer_path: str = TOKENIZER, percentile: float = PERCENTILE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_blocks, block_starts, payload) of each row; no shuffle."""
    bounded_batches(docs.sparkSession)
    light = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = light.schema["doc_id"].dataType.simpleString()
    return light.mapInArrow(_encoder(tokenizer_path, percentile), f"doc_id {kind}, n_tokens bigint, n_blocks int, block_starts array<int>, payload binary")


def decoded(blocks: DataFrame) -> DataFrame:
    """(doc_id, ids) of encode()'s rows; null where the payload is."""
    kind = blocks.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payload, starts = batch.column("payload").to_pylist(), batch.column("block_starts").to_pylist()
            ids = [None if p is None else decode(p, s) for p, s in zip(payload, starts)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return blocks.select("doc_id", "block_starts", "payload").mapInArrow(run, f"doc_id {kind}, ids array<bigint>")
