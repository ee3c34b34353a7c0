"""Public tokenizers, read on the driver and sent to the executors."""

from __future__ import annotations

import base64
import functools
import os
import re

from pyspark import Broadcast
from pyspark.sql import SparkSession

FOLDER = os.environ.get("PORTOLAN_TOKENIZERS", "/opt/tokenizers")
#: A SentencePiece model; 15 bits tell its ids apart.
PIECES, PIECES_VOCABULARY, PIECES_END = f"{FOLDER}/piece_bpe_32k.model", 32_000, 2
#: Ranks of a byte-level BPE, which is faster; its ids need 16 bits with the end's.
BYTES, BYTES_END = f"{FOLDER}/byte_bpe_multi_50k.tiktoken", 50_256
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LONG_RUN = 4096  # of blanks, beyond which the pattern's look-ahead would need too deep a stack


class Ranks:
    """Byte-level BPE over ``PATTERN``; any text comes back as it was."""

    def __init__(self, data: bytes, long_run: int = LONG_RUN):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        made = lambda pattern: tiktoken.Encoding("portolan", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        inner, self.one = made(PATTERN), made(r"[\s\S]+")
        self.inner, self.decode, self.run = inner, inner.decode, re.compile(rf"\s{{{long_run},}}")

    def encode(self, text: str) -> list[int]:
        m = self.run.search(text)
        if not m:
            return self.inner.encode_ordinary(text)
        # What comes before a run of blanks ends with it, and the pattern leaves the run's last blank to what follows.
        out, at = [], 0
        while m:
            end = m.end() if m.end() == len(text) else m.end() - 1
            out += self.inner.encode_ordinary(text[at : m.start()])
            out += self.one.encode_ordinary(text[m.start() : end])
            at = end
            m = self.run.search(text, m.end())
        return out + self.inner.encode_ordinary(text[at:])


class Pieces:
    """SentencePiece BPE; a text comes back as it was, but for U+2581, the model's own sign for a space."""

    def __init__(self, data: bytes):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.encode, self.decode = model.encode, model.decode


def ship_model(spark: SparkSession, path: str) -> Broadcast:
    """The file's kind and bytes, under a megabyte; executors need no file of their own."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast((path.rpartition(".")[2], f.read()))


@functools.lru_cache(maxsize=2)
def tokenizer(kind: str, data: bytes) -> Ranks | Pieces:
    return Ranks(data) if kind == "tiktoken" else Pieces(data)
