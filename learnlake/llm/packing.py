"""Best-fit packing of token sequences by exact complements.

A sequence holds at most ``capacity`` tokens, so documents differ, for packing,
by their length alone: the table of counts by length (``capacity`` entries at
most, whatever the corpus) is all that the packer sees. It takes lengths from
the longest down and looks for one, two or three other lengths that fill the
gap exactly, as often as the counts allow; what finds no exact partner goes
best-fit into the open sequences. The plan is a short list of (lengths, how
often). Pieces are numbered within their length, in parallel, and the number
leads to a place of the plan.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from learnlake.llm.common import materialize, small_batches, unused_name

CAPACITY = 2048
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Encoder:
    """Token ids of a byte-level BPE file of the tokenizers library, as little-endian uint32 bytes.

    The ids are those of the library with add_special_tokens=False; tiktoken's
    merge loop, fed with the file's own vocabulary, yields them several times
    faster. Vocabularies of which the ids don't rise in the order of the merges
    are left to the library itself, and so are texts that hold an added token,
    such as <|endoftext|>. With ``literal`` added tokens are plain text, as with
    the library's encode_special_tokens.
    """

    PROBE = ["", " ", "It's 12,345  words\n\n of\ttext!?  ", "Größe, naïve \u00a0 日本語 🙂 <|endoftext|>"]
    # The public pattern of byte-level BPE, as the library has it built in.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str, literal: bool = False):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.fast = None
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocabulary = file["model"]["vocab"]
        self.added = [] if literal else [t["content"] for t in file.get("added_tokens") or []]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
        if all(c in letters for token in vocabulary for c in token if not token.startswith("<|")):
            ranks = {bytes(letters[c] for c in token): i for token, i in vocabulary.items() if not token.startswith("<|")}
            fast = tiktoken.Encoding("file", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})
            if all(fast.encode_ordinary(t) == self.library.encode(t, add_special_tokens=False).ids for t in self.PROBE):
                self.fast = fast
        self.library.encode_special_tokens = literal

    def __call__(self, text: str) -> bytes:
        fast = self.fast and not any(t in text for t in self.added)
        ids = self.fast.encode_ordinary(text) if fast else self.library.encode(text, add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes()


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0, literal: bool = True) -> DataFrame:
    """Documents as pieces of at most ``capacity`` tokens, each with a CRC-32 of its ids.

    A null text counts as empty; every document ends with ``end_id``, so an
    empty one is one token long. Only the first piece of a longer document is
    shorter than the rest. Repeated rows give repeated pieces. ``literal`` is
    the Encoder's.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = Encoder(tokenizer_path, literal)
        end = int(end_id).to_bytes(4, "little")
        for frame in frames:
            rows = []
            for doc_id, text in zip(frame["doc_id"], frame["text"]):
                packed = encode(text or "") + end
                n = len(packed) // 4
                bounds = [0, *range(n % capacity or capacity, n, capacity), n]
                rows += [(doc_id, k, s, e - s, zlib.crc32(packed[4 * s : 4 * e])) for k, (s, e) in enumerate(zip(bounds, bounds[1:]))]
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield out.astype({"piece": "int32", "doc_id": "Int64"})

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, PIECES)


def plan_packing(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences) for pieces counted by length."""
    left = [0] * (capacity + 1)
    for length, n in counts.items():
        left[length] = n
    plan: list[tuple[tuple[int, ...], int]] = []

    def often(lengths: tuple[int, ...]) -> int:
        return min(left[x] // k for x, k in Counter(lengths).items())

    def take(lengths: tuple[int, ...]) -> None:
        n = often(lengths)
        for x in lengths:
            left[x] -= n
        plan.append((lengths, n))

    # Counts only fall, so a pair that has run out never comes back and each sum's pointer only moves down.
    pair_at = [s - 1 for s in range(capacity + 1)]

    def pair(s: int) -> tuple[int, int] | None:
        a = pair_at[s]
        while 2 * a >= s and a > 0 and not (left[a] and left[s - a] and (2 * a != s or left[a] > 1)):
            a -= 1
        pair_at[s] = a
        return (a, s - a) if a > 0 and 2 * a >= s else None

    for length in range(capacity, 0, -1):
        gap = capacity - length
        if not gap:
            if left[length]:
                take((length,))
            continue
        while left[length] and often((length, gap)):
            take((length, gap))
        # a partner that is the anchor itself, or twice the same, needs that many copies
        while left[length] and (p := pair(gap)):
            if often((length, *p)):
                take((length, *p))
            else:
                pair_at[gap] -= 1
        a = gap - 2
        while left[length] and a > 0 and 3 * a >= gap:
            if left[a] and (p := pair(gap - a)):
                if n := often((length, a, *p)):
                    take((length, a, *p))
                    if n:
                        continue
            a -= 1

    # Best fit for the rest: open sequences by gap, each kind with its number.
    open_by_gap: dict[int, list[list]] = {}
    gaps = np.zeros(capacity + 1, dtype=bool)
    for length in range(capacity, 0, -1):
        n = left[length]
        while n:
            fits = np.flatnonzero(gaps[length:])
            if not fits.size:
                each = capacity // length
                many, rest = divmod(n, each)
                for times, k in ((many, each), (1 if rest else 0, rest)):
                    if times:
                        g = capacity - k * length
                        open_by_gap.setdefault(g, []).append([(length,) * k, times])
                        gaps[g] = True
                n = 0
                continue
            g = int(fits[0]) + length
            kind = open_by_gap[g][-1]
            used = min(n, kind[1])
            kind[1] -= used
            if not kind[1]:
                open_by_gap[g].pop()
                gaps[g] = bool(open_by_gap[g])
            open_by_gap.setdefault(g - length, []).append([(*kind[0], length), used])
            gaps[g - length] = True
            n -= used
    plan += [(tuple(lengths), times) for kinds in open_by_gap.values() for lengths, times in kinds]
    return plan


def plan_places(plan: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length, by rising number within it: from which number on, first sequence, offset."""
    next_number: Counter = Counter()
    rows: dict[int, list[tuple[int, int, int]]] = {}
    sequence = 0
    for lengths, times in plan:
        offset = 0
        for x in lengths:
            rows.setdefault(x, []).append((next_number[x], sequence, offset))
            next_number[x] += times
            offset += x
        sequence += times
    return {x: tuple(np.array(v, dtype=np.int64).T) for x, v in rows.items()}


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, buckets: int = 256) -> DataFrame:
    """Each piece with the sequence and offset that it gets.

    ``pieces`` has doc_id, start, ids_crc32 and a long column length from 1 to
    capacity; other columns stay. Only the counts by length reach the driver.
    Numbers within a length come from (length, bucket) windows and the buckets'
    starts; there are at least ``buckets`` of them and one for each 65,536
    pieces of the commonest length, so a length that a third of all pieces share
    is split. The pieces are stored once with the hash that deals them, and all
    that follows reads that one copy.
    """
    mark, bucket, number, count, start = (unused_name(pieces, f"_{x}") for x in ("hash", "bucket", "number", "n", "from"))
    stored = materialize(pieces.withColumn(mark, F.xxhash64("doc_id", "start", "ids_crc32", F.monotonically_increasing_id())))
    counts = {r["length"]: r["n"] for r in stored.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = plan_places(plan_packing(counts, capacity))
    keyed = stored.withColumn(bucket, F.pmod(mark, F.lit(max(buckets, -(-max(counts.values(), default=0) // 65_536)))))
    starts = (
        keyed.groupBy("length", bucket)
        .agg(F.count(F.lit(1)).alias(count))
        .withColumn(start, F.coalesce(F.sum(count).over(Window.partitionBy("length").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .drop(count)
    )
    order = Window.partitionBy("length", bucket).orderBy("doc_id", "start", "ids_crc32")
    numbers = keyed.withColumn(number, F.row_number().over(order)).join(starts, ["length", bucket])
    numbers = numbers.select(*pieces.columns, (F.col(start) + F.col(number) - 1).alias(number))
    out = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in pieces.schema)}, sequence_id long, offset long"

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            length, nth = frame["length"].to_numpy(), frame[number].to_numpy()
            sequence, offset = np.empty(len(frame), np.int64), np.empty(len(frame), np.int64)
            for x in np.unique(length):
                own = np.flatnonzero(length == x)
                since, first, at = places[int(x)]
                k = np.searchsorted(since, nth[own], side="right") - 1
                sequence[own] = first[k] + nth[own] - since[k]
                offset[own] = at[k]
            yield frame.drop(columns=number).assign(sequence_id=sequence, offset=offset)

    return numbers.mapInPandas(place, out)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0, literal: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece.

    Documents are tokenised once; the pieces are kept in the checkpoint folder
    for the count and for the numbering. An empty table gives no rows; null
    texts and ids, repeated rows and further columns are allowed. op6_packing
    and the pipeline set ``literal`` to False: an added token within a text has
    its own id.
    """
    return pack_pieces(token_pieces(docs, tokenizer_path, capacity, end_id, literal), capacity)
