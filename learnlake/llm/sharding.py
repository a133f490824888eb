"""Sharding by a keyed permutation of global row numbers.

A Feistel network over Z_a x Z_b (a*b just above the number of rows) permutes
the row numbers; a value that falls beyond the last row is walked along its
cycle until it falls inside. Row number, place, shard and slot are then plain
arithmetic: each can be worked out from any other without the table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from learnlake.llm.common import mix64, numbered, utf8_crc32

ROUNDS = 6


class Permutation:
    """A bijection of range(total) that seed and total decide."""

    def __init__(self, total: int, seed: int = 0):
        self.total = max(int(total), 1)
        self.a = math.isqrt(self.total - 1) + 1
        self.b = -(-self.total // self.a)
        with np.errstate(over="ignore"):
            keys = np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed % 2**64)
            self.keys = mix64(keys)

    def _term(self, i: int, half: np.ndarray, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mix64(half.astype(np.uint64) + self.keys[i]) % np.uint64(size)).astype(np.int64)

    def _pass(self, x: np.ndarray) -> np.ndarray:
        left, right = x // self.b, x % self.b
        for i in range(ROUNDS):
            if i % 2 == 0:
                left = (left + self._term(i, right, self.a)) % self.a
            else:
                right = (right + self._term(i, left, self.b)) % self.b
        return left * self.b + right

    def _pass_back(self, x: np.ndarray) -> np.ndarray:
        left, right = x // self.b, x % self.b
        for i in reversed(range(ROUNDS)):
            if i % 2 == 0:
                left = (left - self._term(i, right, self.a)) % self.a
            else:
                right = (right - self._term(i, left, self.b)) % self.b
        return left * self.b + right

    def _walk(self, x, step) -> np.ndarray:
        out = step(np.atleast_1d(np.asarray(x, dtype=np.int64)))
        while (beyond := out >= self.total).any():
            out[beyond] = step(out[beyond])
        return out

    def place(self, row_no) -> np.ndarray:
        """Row numbers to places of the shuffled order."""
        return self._walk(row_no, self._pass)

    def row(self, place) -> np.ndarray:
        """Places of the shuffled order to row numbers."""
        return self._walk(place, self._pass_back)


def row_at(shard: int, slot: int, total: int, shards: int, seed: int = 0) -> int:
    """The row number that stands in a slot of a shard."""
    return int(Permutation(total, seed).row(slot * shards + shard)[0])


def shard_rows(df: DataFrame, shards: int = 16, seed: int = 0) -> DataFrame:
    """Every row of df with row_no, n_rows, shard and slot; shard sizes differ by one at most.

    Rows are told apart by all of df's columns (which must be sortable and not
    named row_no or n_rows); equal rows get numbers of their own. Null values
    sort first. An empty table gives an empty table. The result is the same
    for any files, partitions and order of the input.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    rows = numbered(df)
    out = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, shard int, slot long"

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[int, Permutation] = {}
        for frame in frames:
            if len(frame):
                total = int(frame["n_rows"].iloc[0])
                perm = known.setdefault(total, Permutation(total, seed))
                at = perm.place(frame["row_no"].to_numpy())
                yield frame.assign(shard=(at % shards).astype(np.int32), slot=at // shards)

    return rows.mapInPandas(place, out)


def shard_documents(docs: DataFrame, shards: int = 16, seed: int = 0, carry: tuple[str, ...] = ()) -> DataFrame:
    """Shard and slot for each document, under the law ``rows``.

    A document is its doc_id, size (UTF-8 bytes of the text plus 1, so 1 for a
    null or empty text) and CRC-32; only those are shuffled. ``carry`` names
    further columns to keep, the text for example. Nulls, repeated rows and
    columns with any other name are allowed.
    """
    keys = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        utf8_crc32(F.col("text")).alias("text_crc32"),
        *[F.col(c) for c in carry],
    )
    return shard_rows(keys, shards, seed)


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder a shard, rows in the order of their slots."""
    sharded.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
