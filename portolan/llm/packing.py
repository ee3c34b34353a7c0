"""Packing token ids into windows of a fixed number, in bounded space.

Each partition keeps a fixed number of open windows. A piece goes into the one
it fits best; where none has room and no more may be open, the fullest is
closed. What is open at a partition's end is merged with that of others.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portolan.llm.tokens import BYTES, BYTES_END, ship_model, tokenizer
from portolan.session import arrow_batches, materialize, ship_code

SCHEMA = "window_id long, n_tokens long, doc_ids array<long>, starts array<long>, lengths array<long>, token_ids array<int>"
#: Within pandas, ids are texts: as numbers, a null among them would make them floats and cut off long ones.
_STAGED = SCHEMA.replace("doc_ids array<long>", "doc_ids array<string>") + ", part long, open boolean"


@dataclass(frozen=True)
class PackParams:
    window: int = 2048
    open_windows: int = 64
    fan_in: int = 64  # partitions whose leftovers are merged by one task
    batch_rows: int = 1000  # documents that a Python worker holds at once
    model_path: str = BYTES
    end_id: int = BYTES_END


class Packer:
    """Best fit over at most ``limit`` open windows. Items are (length, payload); a payload is a list of segments."""

    def __init__(self, window: int, limit: int):
        self.window, self.limit = window, limit
        self.room: list[tuple[int, int]] = []  # (free tokens, window), ascending
        self.held: dict[int, list] = {}
        self.next = 0

    def place(self, length: int, segments: list) -> Iterator[tuple[int, list]]:
        """Put a piece of 1 to ``window`` tokens somewhere; gives the windows this closes, as (tokens, segments)."""
        at = bisect_left(self.room, (length, -1))
        if at < len(self.room):
            free, k = self.room.pop(at)
            self.held[k] += segments
        else:
            if len(self.room) >= self.limit:
                free, k = self.room.pop(0)
                yield self.window - free, self.held.pop(k)
            free, k = self.window, self.next
            self.next += 1
            self.held[k] = list(segments)
        free -= length
        if free:
            insort(self.room, (free, k))
        else:
            yield self.window, self.held.pop(k)

    def rest(self) -> list[tuple[int, list]]:
        return [(self.window - free, self.held[k]) for free, k in self.room]


def _frame(windows: list[tuple[int, list, bool]], part: int, level: int, first: int) -> pd.DataFrame:
    return pd.DataFrame({
        "window_id": [(level << 56) | (part << 32) | (first + i) for i in range(len(windows))],
        "n_tokens": [n for n, _, _ in windows],
        **{c: [[s[j] for s in segments] for _, segments, _ in windows] for j, c in enumerate(("doc_ids", "starts", "lengths"))},
        "token_ids": [np.concatenate([s[3] for s in segments]) for _, segments, _ in windows],
        "part": part,
        "open": [o for _, _, o in windows],
    })


def _batch(windows: list[tuple[int, list, bool]], part: int, first: int) -> pa.RecordBatch:
    """The same for closed windows as they come, without an object for each id."""
    flat = [s for _, segments, _ in windows for s in segments]
    at = pa.array(np.cumsum([0] + [len(segments) for _, segments, _ in windows]), pa.int32())
    lists = [pa.ListArray.from_arrays(at, pa.array([s[j] for s in flat], kind)) for j, kind in enumerate((pa.string(), pa.int64(), pa.int64()))]
    tokens = pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [n for n, _, _ in windows]), pa.int32()), pa.array(np.concatenate([s[3] for s in flat])))
    ids = pa.array([(part << 32) | (first + i) for i in range(len(windows))], pa.int64())
    count, opened = pa.array([n for n, _, _ in windows], pa.int64()), pa.array([o for _, _, o in windows])
    return pa.RecordBatch.from_arrays([ids, count, *lists, tokens, pa.array([part] * len(windows), pa.int64()), opened], ["window_id", "n_tokens", "doc_ids", "starts", "lengths", "token_ids", "part", "open"])


def _merger(p: PackParams, level: int, last: bool):
    """Packs one group's leftovers, largest first; but for the last level the emptiest windows stay open."""

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        packer, windows = Packer(p.window, len(pdf)), []
        pdf = pdf.sort_values(["n_tokens", "window_id"], ascending=[False, True])
        for n, ids, starts, lengths, tokens in zip(pdf["n_tokens"], pdf["doc_ids"], pdf["starts"], pdf["lengths"], pdf["token_ids"]):
            segments = [(k, int(s), int(m), t) for k, s, m, t in zip(ids, starts, lengths, np.split(tokens, np.cumsum(lengths)[:-1]))]
            windows += [(m, s, False) for m, s in packer.place(int(n), segments)]
        rest = sorted(packer.rest(), key=lambda x: x[0])
        windows += [(m, s, not last and i < p.open_windows) for i, (m, s) in enumerate(rest)]
        return _frame(windows, int(key[0]), level, 0)

    return merge


def pack(docs: DataFrame, params: PackParams = PackParams(), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Windows of at most ``window`` token ids: their documents' ids, each piece's start in its document and its length, and the ids.

    A document is its text's ids and then the end id. Each id of each document
    is in exactly one window; a document longer than a window is cut into
    whole windows and a rest, and none is left out. A null or blank text is in
    no window. A null doc_id is a null in the list; repeated rows are packed
    each by itself. Only id and text are read, whatever other columns there
    are. An empty table gives no windows. Windows depend on how the input is
    partitioned; their contents don't.
    """
    p = params
    ship_code(docs.sparkSession)
    model = ship_model(docs.sparkSession, p.model_path)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        packer, made, encode = Packer(p.window, p.open_windows), 0, tokenizer(*model.value).encode
        for batch in batches:
            closed = []
            for k, t in zip(batch.column(0).to_pylist(), (x.as_py() for x in batch.column(1))):
                if not t or not t.strip():
                    continue
                ids = np.array([*encode(t), p.end_id], np.int32)
                for start in range(0, len(ids), p.window):
                    piece = ids[start : start + p.window]
                    closed += [(m, s, False) for m, s in packer.place(len(piece), [(k, start, len(piece), piece)])]
                if len(closed) >= 256:
                    yield _batch(closed, part, made)
                    made += len(closed)
                    closed = []
            if closed:
                yield _batch(closed, part, made)
                made += len(closed)
        left = [(m, s, True) for m, s in packer.rest()]
        if left:
            yield _batch(left, part, made)

    rows = docs.select(F.col(f"`{doc_id}`").cast("string").alias("k"), F.col(f"`{text}`").alias("t"))
    with arrow_batches(docs.sparkSession, p.batch_rows):
        staged = materialize(rows.mapInArrow(fill, _STAGED), "pack-windows")
    out = staged.filter("not open")
    parts = (staged.agg(F.max("part")).first()[0] or 0) + 1
    level = 0
    while True:
        level += 1
        last = parts <= p.fan_in
        grouped = staged.filter("open").withColumn("part", F.floor(F.col("part") / p.fan_in).cast("long"))
        staged = grouped.groupBy("part").applyInPandas(_merger(p, level, last), _STAGED)
        if last:
            return out.unionByName(staged).drop("part", "open").withColumn("doc_ids", F.col("doc_ids").cast("array<long>"))
        staged = materialize(staged, "pack-leftovers")
        out = out.unionByName(staged.filter("not open"))
        parts = -(-parts // p.fan_in)
