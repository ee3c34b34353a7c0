"""Token ids in as many bits as the vocabulary needs.

Ids lie one after the other in blocks of a fixed number of ids; a block begins
at a byte of its own, so any id is reached through its block's offset. 64 ids
fill as many 64-bit words as an id has bits, which makes packing and unpacking
a handful of numpy operations for each of 64 places.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portolan.llm.tokens import PIECES, PIECES_END, PIECES_VOCABULARY, ship_model, tokenizer
from portolan.session import ship_code

U = np.uint64


def bits_for(vocabulary: int) -> int:
    """The least number of bits that tells ``vocabulary`` ids apart; 1 at least."""
    if vocabulary < 1:
        raise ValueError("a vocabulary has an id at least")
    return max(1, (vocabulary - 1).bit_length())


def pack_ids(ids: np.ndarray, bits: int) -> bytes:
    """Ids below 2^bits as little-endian words, the last group of 64 filled up with zeros."""
    ids = np.asarray(ids)
    if len(ids) and (int(ids.min()) < 0 or int(ids.max()) >> bits):
        raise ValueError(f"an id needs more than {bits} bits")
    groups = -(-len(ids) // 64)
    full = np.zeros(groups * 64, U)
    full[: len(ids)] = ids
    full = full.reshape(groups, 64)
    words = np.zeros((groups, bits), U)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        words[:, word] |= full[:, j] << U(shift)
        if shift + bits > 64:
            words[:, word + 1] |= full[:, j] >> U(64 - shift)
    return words.astype("<u8").tobytes()


def unpack_ids(data: bytes, bits: int, count: int) -> np.ndarray:
    """The first ``count`` ids of ``pack_ids``."""
    words = np.frombuffer(data, "<u8").astype(U).reshape(-1, bits)
    out = np.empty((len(words), 64), np.uint32)
    mask = U((1 << bits) - 1)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        x = words[:, word] >> U(shift)
        if shift + bits > 64:
            x = x | (words[:, word + 1] << U(64 - shift))
        out[:, j] = x & mask
    return out.reshape(-1)[:count]


@dataclass(frozen=True)
class PackedIds:
    """Reader of one row of ``pack_documents``."""

    bits: int
    block_ids: int
    n_tokens: int
    block_offsets: np.ndarray
    data: bytes

    def all(self) -> np.ndarray:
        return unpack_ids(self.data, self.bits, self.n_tokens) if self.block_ids % 64 == 0 else self.slice(0, self.n_tokens)

    def slice(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop, unpacking no block without one of them."""
        start, stop = max(0, start), min(stop, self.n_tokens)
        if start >= stop:
            return np.zeros(0, np.uint32)
        first, last = start // self.block_ids, (stop - 1) // self.block_ids
        raw = self.data[self.block_offsets[first] : self.block_offsets[last + 1]]
        have = min(self.n_tokens, (last + 1) * self.block_ids) - first * self.block_ids
        return unpack_ids(raw, self.bits, have)[start - first * self.block_ids : stop - first * self.block_ids]


@dataclass(frozen=True)
class TokenParams:
    model_path: str = PIECES
    vocabulary: int = PIECES_VOCABULARY
    end_id: int = PIECES_END
    block_ids: int = 4096  # a multiple of 64
    shard_ids: int = 1 << 20


SHARD = "shard_id long, bits int, block_ids int, n_tokens long, doc_ids array<long>, doc_starts array<long>, block_offsets array<long>, data binary"


def pack_documents(docs: DataFrame, params: TokenParams = TokenParams(), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Rows of about ``shard_ids`` packed ids of whole documents: doc_ids, the first id's place of each, and block offsets in bytes.

    Each document is its ids and then the end id, so doc_starts has one entry
    more than there are documents: document i is ids doc_starts[i] to
    doc_starts[i+1] - 1. A null or empty text is the end id alone; a null
    doc_id is a null in the list; repeated rows are stored as often as they
    occur. A text of any length is stored whole, in one row. Only id and text
    are read; an empty table gives no rows. What a row holds depends on the
    input's partitions, not which documents there are.
    """
    p = params
    bits = bits_for(p.vocabulary)
    if p.block_ids % 64 or p.end_id >= p.vocabulary:
        raise ValueError("blocks are multiples of 64 ids, and the end id is in the vocabulary")
    ship_code(docs.sparkSession)
    model = ship_model(docs.sparkSession, p.model_path)

    def shard(part: int, k: int, names: list, chunks: list[np.ndarray]) -> pd.DataFrame:
        sizes = np.array([len(x) for x in chunks], np.int64)
        ids = np.concatenate(chunks)
        blocks = -(-len(ids) // p.block_ids)
        data = pack_ids(ids, bits)
        offsets = np.minimum(np.arange(blocks + 1, dtype=np.int64) * (p.block_ids * bits // 8), len(data))
        return pd.DataFrame({"shard_id": [(part << 32) | k], "bits": [bits], "block_ids": [p.block_ids], "n_tokens": [len(ids)], "doc_ids": [names], "doc_starts": [np.r_[0, np.cumsum(sizes)]], "block_offsets": [offsets], "data": [data]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = tokenizer(*model.value).encode
        part, made, size = TaskContext.get().partitionId(), 0, 0
        names: list = []
        chunks: list[np.ndarray] = []
        for pdf in batches:
            for k, t in zip(pdf["k"].tolist(), pdf["t"].tolist()):
                ids = np.array([*encode(t or ""), p.end_id], np.uint32)
                names.append(None if k is None else int(k))
                chunks.append(ids)
                size += len(ids)
                if size >= p.shard_ids:
                    yield shard(part, made, names, chunks)
                    made, size, names, chunks = made + 1, 0, [], []
        if chunks:
            yield shard(part, made, names, chunks)

    return docs.select(F.col(f"`{doc_id}`").cast("string").alias("k"), F.col(f"`{text}`").alias("t")).mapInPandas(run, SHARD)
