"""N-gram Jaccard self join as a blocked sparse matrix product.

A document is a sparse row over its distinct word n-grams (hashes of HASH_BITS). The
product of that matrix with its transpose holds the overlap of every pair, and
a pair links when ``100 * overlap >= percent * union``. The product is never
formed whole:

1. Each column's number of rows comes from one exchange that is dealt by
   ranges of the hash. Columns with one row add nothing to any overlap and are
   dropped there; a column that many rows of a batch hold travels once.
2. A row of n columns needs ``percent`` of them shared, so a row that keeps
   fewer than that is linked with nothing and leaves. Equal rows become one.
3. By rising column count, a linked pair must meet in the first
   ``m - ceil(percent * n / 100) + 1`` of its m shared columns. Rows that meet
   there form the blocks.
4. Blocks of a few hundred rows are multiplied, column chunk by column chunk,
   and give at most one link a row. A second deal with other blocks joins what
   the first left apart.
5. Where rows of different components still meet, those outside the list's main
   component are multiplied, block by block, with all rows of the lists of that
   main component; sizes that rule a link out are skipped. After that no link
   is missing.

Dense groups of near copies thus cost a few passes over their rows, while the
components are exactly those of all links.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from learnlake.llm.common import BROADCAST_ROWS, by_range, checked_broadcast, hash_ranges, lower_words, materialize, mix64, quoted, release, small_batches, unused_name

#: Documents and characters that are hashed together.
BATCH_DOCS, BATCH_CHARS = 1_500, 2_500_000
#: Bits of an n-gram's hash, of which the lower bytes travel in full. Two different n-grams of one pair of
#: documents with 1,000 each meet with a chance of 1 in 10^10.
HASH_BITS, LOW_BYTES = 56, 5
#: Rows of a block of the product.
BLOCK_ROWS = 256
#: Edges of one partition while components are found.
ROWS_A_PART = 500_000
#: Cells of a dense column chunk, and entries whose columns are numbered at once.
CHUNK_CELLS, SLICE = 2_000_000, 1_000_000

_ROW = "batch string, p int, kind int, grams binary, more binary, docs binary, counts binary"
_ROW_COLUMNS = ["batch", "p", "kind", "grams", "more", "docs", "counts"]
_DOC = "doc_id long, n_shingles long, k binary, grams binary, prefix array<long>"


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 100_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_hashes(words: np.ndarray, start: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Document numbers and hashes of all n-grams; document d has words start[d] to start[d + 1].

    A document of fewer words, but not none, gives its whole sequence.
    """
    count = np.diff(start)
    doc = np.repeat(np.arange(len(count)), count)
    left = np.repeat(start[1:], count) - np.arange(len(words))
    h = np.zeros(len(words), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            step = np.zeros(len(words), np.uint64)
            step[: len(words) - k] = words[k:]
            step[left <= k] = np.uint64(k)  # beyond a short document's end
            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + step + np.uint64(k + 1))
    first = np.zeros(len(words), bool)
    first[start[:-1][count > 0]] = True
    keep = (left >= size) | first
    return doc[keep], h[keep]


def incidence(texts: list[str | None], size: int, known: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (hash, document) entries by rising hash, then document."""
    words, start = [], [0]
    for text in texts:
        words += map(known.__getitem__, lower_words(text))
        start.append(len(words))
    doc, gram = shingle_hashes(np.array(words, np.uint64), np.array(start), size)
    gram = gram >> np.uint64(64 - HASH_BITS)
    order = np.lexsort((doc, gram))
    doc, gram = doc[order], gram[order]
    new = np.ones(len(doc), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (doc[1:] != doc[:-1])
    return gram[new], doc[new]


def pack_sorted(grams: np.ndarray, low_bytes: int = 6) -> bytes:
    """Rising numbers as their lower bytes and, for each upper part, how many have it."""
    top = grams >> np.uint64(8 * low_bytes)
    lo = int(top[0]) if len(top) else 0
    counts = np.bincount((top - np.uint64(lo)).astype(np.int64)).astype("<u4") if len(top) else np.empty(0, "<u4")
    low = grams.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :low_bytes]
    return np.array([len(grams), lo, len(counts), low_bytes], "<u4").tobytes() + counts.tobytes() + low.tobytes()


def unpack_sorted(raw: bytes) -> np.ndarray:
    n, lo, tops, low_bytes = np.frombuffer(raw, "<u4", 4).tolist()
    counts = np.frombuffer(raw, "<u4", tops, 16)
    out = np.zeros((n, 8), np.uint8)
    out[:, :low_bytes] = np.frombuffer(raw, np.uint8, low_bytes * n, 16 + 4 * tops).reshape(n, low_bytes)
    top = np.repeat(np.arange(tops, dtype=np.uint64) + np.uint64(lo), counts)
    return out.reshape(-1).view("<u8") + (top << np.uint64(8 * low_bytes))


def _batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        chars = frame["text"].str.len().fillna(0).to_numpy().cumsum()
        part = np.maximum(chars // BATCH_CHARS, np.arange(len(frame)) // BATCH_DOCS)
        edges = np.flatnonzero(np.diff(part, prepend=-1) != 0)
        for lo, hi in zip(edges, [*edges[1:], len(frame)]):
            yield frame.iloc[lo:hi]


def _requests(size: int, parts: int):
    """For each batch one row per hash range that it has n-grams of (kind 2), and what it knows by itself (kinds 0 and 1).

    A batch's name holds a digest of all its entries, and its head says how many
    requests it makes. Were a lost task to find other rows when it runs again,
    its answers would bear another name and some of them would be missing.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task, known = TaskContext.get().partitionId(), WordHashes()
        bounds = np.array([-(-(p << HASH_BITS) // parts) for p in range(1, parts)], dtype=np.uint64)
        for number, frame in enumerate(_batches(frames)):
            gram, doc = incidence(frame["text"].tolist(), size, known)
            first = np.flatnonzero(np.diff(gram, prepend=~gram[:1]) != 0)
            many = np.diff(np.append(first, len(gram)))
            n_docs = len(frame)
            n = np.bincount(doc, minlength=n_docs)
            sums = np.zeros((2, n_docs), np.uint64)
            with np.errstate(over="ignore"):
                for k, seed in enumerate((0x51ED270B, 0xA0761D64)):
                    np.add.at(sums[k], doc, mix64(gram + np.uint64(seed)))
            ids = frame["doc_id"]
            has_id = ids.notna().to_numpy()
            of_many = np.repeat(many > 1, many)
            head = np.concatenate([has_id.astype(np.int64), ids.fillna(0).astype(np.int64).to_numpy(), n]).astype(np.int64)
            name = f"{task}-{number}-{hashlib.sha1(b''.join((gram.tobytes(), doc.tobytes(), head.tobytes()))).hexdigest()[:16]}"
            home = zlib.crc32(name.encode()) % parts
            one, several, shared_by = first[many == 1], first[many > 1], many[many > 1].astype(np.uint16)
            rows = []
            one_at, several_at = [0, *np.searchsorted(gram[one], bounds), len(one)], [0, *np.searchsorted(gram[several], bounds), len(several)]
            for p in range(parts):
                a, b = one[one_at[p] : one_at[p + 1]], slice(several_at[p], several_at[p + 1])
                if len(a) or b.start < b.stop:
                    rows.append((name, p, 2, pack_sorted(gram[a], LOW_BYTES), pack_sorted(gram[several[b]], LOW_BYTES), doc[a].astype(np.uint16).tobytes(), shared_by[b].tobytes()))
            head = np.concatenate([[n_docs, len(rows)], head])
            rows.append((name, home, 0, pack_sorted(gram[several], LOW_BYTES), b"", doc[of_many].astype(np.uint16).tobytes(), shared_by.tobytes()))
            rows.append((name, home, 1, sums.tobytes(), b"", head.tobytes(), b""))
            yield pd.DataFrame(rows, columns=_ROW_COLUMNS)

    return run


def _count_columns(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Answers each request: its single entries that other batches share, and the counts of its shared ones.

    Requests come in the order of their range, of which one is held at a time.
    """
    asked: list[tuple] = []
    for frame in frames:
        own = frame["kind"] < 2
        if own.any():
            yield frame[own]
        for row in frame.loc[~own, ["batch", "p", "grams", "more", "docs", "counts"]].itertuples(index=False, name=None):
            if asked and asked[0][1] != row[1]:
                yield from _answers(asked)
                asked = []
            asked.append(row)
    if asked:
        yield from _answers(asked)


def _answers(asked: list[tuple]) -> Iterator[pd.DataFrame]:
    grams, counts = [], []
    for _, _, one, more, docs, times in asked:
        grams += [unpack_sorted(one), unpack_sorted(more)]
        counts += [np.ones(len(docs) // 2, np.uint16), np.frombuffer(times, np.uint16)]
    sizes = [len(g) for g in grams]
    _, at = np.unique(np.concatenate(grams), return_inverse=True)
    total = np.bincount(at, weights=np.concatenate(counts))
    found = np.split(np.minimum(total, 65_535).astype(np.uint16)[at], np.cumsum(sizes)[:-1])
    rows = []
    for k, (name, p, _, _, docs, _) in enumerate(asked):
        one, more = found[2 * k], found[2 * k + 1]
        shared = one > 1
        rows.append((name, p, 2, pack_sorted(grams[2 * k][shared], LOW_BYTES), b"", np.frombuffer(docs, np.uint16)[shared].tobytes(), one[shared].tobytes()))
        if len(more):
            rows.append((name, p, 3, b"", b"", b"", more.tobytes()))
    yield pd.DataFrame(rows, columns=_ROW_COLUMNS)


def _assemble(percent: int):
    """The documents of a batch; those that can link keep their shared columns, by rising count."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        kinds = {k: f for k, f in frame.sort_values("p").groupby("kind")}
        head = np.frombuffer(kinds[1]["docs"].iloc[0], np.int64) if 1 in kinds else np.array([0, -1])
        if len(kinds.get(1, ())) != 1 or len(kinds.get(2, ())) != head[1]:
            raise ValueError(f"batch {frame['batch'].iloc[0]}: the input gave other rows when a lost task ran again")
        head = head[[0, *range(2, len(head))]]
        sums = np.frombuffer(kinds[1]["grams"].iloc[0], np.uint64).reshape(2, -1)
        n_docs = int(head[0])
        has_id, ids, n = head[1 : 1 + n_docs].astype(bool), head[1 + n_docs : 1 + 2 * n_docs], head[1 + 2 * n_docs :]
        join = lambda k, c, t: np.frombuffer(b"".join(kinds[k][c]), t) if k in kinds else np.empty(0, t)
        # the ranges of the hash rise with p, so the answers stand in the order of what the batch holds
        own = unpack_sorted(kinds[0]["grams"].iloc[0])
        many = np.frombuffer(kinds[0]["counts"].iloc[0], np.uint16).astype(np.int64)
        gram = np.concatenate([*map(unpack_sorted, kinds[2]["grams"] if 2 in kinds else []), np.repeat(own, many)])
        doc = np.concatenate([join(2, "docs", np.uint16), np.frombuffer(kinds[0]["docs"].iloc[0], np.uint16)]).astype(np.int64)
        count = np.concatenate([join(2, "counts", np.uint16), np.repeat(join(3, "counts", np.uint16), many)])
        m = np.bincount(doc, minlength=n_docs)
        stays = (n > 0) & (100 * m >= percent * n)
        keep = stays[doc]
        gram, doc, count = gram[keep], doc[keep], count[keep]
        order = np.lexsort((gram, count, doc))
        gram = gram[order]
        ends = np.cumsum(np.bincount(doc, minlength=n_docs))
        out = []
        for d in range(n_docs):
            key = sums[:, d].astype(">u8").tobytes() + int(n[d]).to_bytes(4, "big") if n[d] else None
            own_grams = gram[ends[d] - m[d] : ends[d]] if stays[d] else None
            first = None if own_grams is None else own_grams[: m[d] + (-percent * int(n[d])) // 100 + 1].astype(np.int64)
            out.append((int(ids[d]) if has_id[d] else None, int(n[d]), key, None if own_grams is None else own_grams.tobytes(), first))
        frame = pd.DataFrame(out, columns=["doc_id", "n_shingles", "k", "grams", "prefix"])
        return frame.astype({"doc_id": "Int64"})

    return run


def incidence_rows(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Each document with its set's size and key, and, where it can link at all, its shared columns."""
    small_batches(docs.sparkSession)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts, ranges = hash_ranges(plain)
    counted = by_range(plain.mapInPandas(_requests(size, ranges), _ROW), parts, ranges).mapInPandas(_count_columns, _ROW)
    return counted.repartition(parts, "batch").groupBy("batch").applyInPandas(_assemble(percent), _DOC)


def overlaps(grams: list[np.ndarray]) -> np.ndarray:
    """The product of a block's rows with themselves, accumulated over slices of the hash and column chunks."""
    rows = len(grams)
    overlap = np.zeros((rows, rows), np.float32)
    every = np.concatenate(grams)
    of_row = np.repeat(np.arange(rows, dtype=np.int32), [len(g) for g in grams])
    slices = -(-len(every) // SLICE)
    number = every % np.uint64(max(slices, 1))
    for part in range(slices):
        own = number == part
        _, col, count = np.unique(every[own], return_inverse=True, return_counts=True)
        keep = count[col] > 1
        row, col = of_row[own][keep], (np.cumsum(count > 1) - 1)[col[keep]]
        width = max(1, CHUNK_CELLS // rows)
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
        for lo in range(0, int(col[-1]) + 1 if len(col) else 0, width):
            a, b = np.searchsorted(col, [lo, lo + width])
            chunk = np.zeros((rows, min(width, int(col[b - 1]) - lo + 1)), np.float32)
            chunk[row[a:b], col[a:b] - lo] = 1
            overlap += chunk @ chunk.T
    return overlap


def block_links(grams: list[np.ndarray], n: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among a block's rows."""
    rows, overlap = len(grams), overlaps(grams)
    link = 100 * overlap.astype(np.int64) >= percent * (n[:, None] + n[None, :] - overlap.astype(np.int64))
    np.fill_diagonal(link, False)
    seen, forest = np.zeros(rows, bool), []
    for root in range(rows):
        if not seen[root]:
            seen[root] = True
            todo = [root]
            while todo:
                at = todo.pop()
                new = np.flatnonzero(link[at] & ~seen)
                seen[new] = True
                forest += [(at, int(x)) for x in new]
                todo += new.tolist()
    return forest


def cross_links(grams: list[np.ndarray], n: np.ndarray, comp: list[bytes], is_x: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """For each x row one link to each other component that it links with."""
    m = np.array([len(g) for g in grams])
    least = np.minimum(m[:, None], m[None, :])
    code = np.unique(np.array(comp, dtype=object).astype("S"), return_inverse=True)[1]
    may = is_x[:, None] & (code[:, None] != code[None, :]) & (100 * least >= percent * (n[:, None] + n[None, :] - least))
    use = np.flatnonzero(may.any(0) | may.any(1))
    if not len(use):
        return []
    both = overlaps([grams[i] for i in use]).astype(np.int64)
    n, may, code = n[use], may[np.ix_(use, use)], code[use]
    link = may & (100 * both >= percent * (n[:, None] + n[None, :] - both))
    out = []
    for x in np.flatnonzero(link.any(1)):
        near = np.flatnonzero(link[x])
        out += [(int(use[x]), int(use[y])) for y in near[np.unique(code[near], return_index=True)[1]]]
    return out


def _grouped(columns: list[str], links):
    """Runs of rows with one (token, x, y) to links; a run may go over the edge of a frame."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        for frame in frames:
            out = []
            for row in frame[["token", "x", "y", *columns]].itertuples(index=False, name=None):
                if held and held[0][:3] != row[:3]:
                    out += links(held)
                    held = []
                held.append(row)
            if out:
                yield pd.DataFrame(out, columns=["a", "b"])
        if held and (out := links(held)):
            yield pd.DataFrame(out, columns=["a", "b"])

    return run


def _multiply(percent: int):
    def links(rows: list[tuple]) -> list[tuple[bytes, bytes]]:
        if len(rows) < 2:
            return []
        grams = [np.frombuffer(r[5], np.uint64) for r in rows]
        return [(rows[a][3], rows[b][3]) for a, b in block_links(grams, np.array([r[4] for r in rows]), percent)]

    return _grouped(["k", "n", "grams"], links)


def _cross_multiply(percent: int):
    def links(rows: list[tuple]) -> list[tuple[bytes, bytes]]:
        is_x = np.array([r[5] for r in rows])
        if not is_x.any() or len(rows) < 2:
            return []
        grams = [np.frombuffer(r[7], np.uint64) for r in rows]
        found = cross_links(grams, np.array([r[4] for r in rows]), [bytes(r[6]).hex().encode() for r in rows], is_x, percent)
        return [(rows[a][3], rows[b][3]) for a, b in found]

    return _grouped(["k", "n", "is_x", "comp", "grams"], links)


def components(edges: DataFrame) -> DataFrame:
    """(k, comp) of every end of an edge (a, b): comp is the smallest k of its component.

    Labels spread over the edges and then jump to their label's label, so long
    chains need few rounds. Each round is written to the checkpoint folder. The
    table of labels is broadcast if it is counted to be small, else shuffled.
    """
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    parts = both.count() // ROWS_A_PART + 1  # few edges are few files and tasks a round, whatever the session's partitions
    both = both.coalesce(parts)
    label = materialize(both.groupBy(F.col("a").alias("k")).agg(F.least(F.col("k"), F.min("b")).alias("comp")).coalesce(parts))
    few = label.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS  # the table keeps its size from round to round
    table = lambda *columns: F.broadcast(label.select(*columns)) if few else label.select(*columns)
    while True:
        near = both.join(table(F.col("k").alias("b"), "comp"), "b").groupBy(F.col("a").alias("k")).agg(F.min("comp").alias("near"))
        better = near.join(table("k", "comp"), "k").select("k", F.least("comp", "near").alias("next"), F.col("comp").alias("old"))
        jump = table(F.col("k").alias("next"), F.col("comp").alias("far"))
        moved = materialize(better.join(jump, "next").select("k", F.least("next", "far").alias("comp"), "old").coalesce(parts))
        changed = moved.filter("comp <> old").limit(1).count()
        label = moved.select("k", "comp")
        if not changed:
            return label


def class_links(classes: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) among distinct rows (k, n, grams, prefix) that yield the components of all links."""
    met = classes.select("k", F.explode("prefix").alias("token"))
    lists = checked_broadcast(met.groupBy("token").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"))
    met = materialize(met.join(lists, "token"))
    sets = classes.select("k", "n", "grams")

    def multiplied(chosen: DataFrame, seed: int) -> DataFrame:
        block = F.pmod(F.xxhash64("k", F.lit(seed)), F.ceil(F.col("size") / BLOCK_ROWS))
        dealt = chosen.withColumn("x", block).withColumn("y", F.lit(0)).join(sets, "k").select("token", "x", "y", "k", "n", "grams")
        dealt = dealt.repartition("token", "x").sortWithinPartitions("token", "x")
        return dealt.mapInPandas(_multiply(percent), "a binary, b binary")

    largest = met.groupBy("k").agg(F.max(F.struct("size", "token")).alias("x")).select("k", "x.size", "x.token")
    first = multiplied(largest, 1)
    again = multiplied(largest.filter(F.col("size") > BLOCK_ROWS), 2)
    links = materialize(first.union(again))
    release(classes.sparkSession)
    label = components(links)
    at = met.join(label, "k", "left").withColumn("comp", F.coalesce("comp", "k"))
    per_comp = at.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("c"))
    main = per_comp.groupBy("token").agg(F.max(F.struct("c", "comp")).alias("x"), F.count(F.lit(1)).alias("comps")).filter("comps > 1")
    at = at.join(checked_broadcast(main.select("token", F.col("x.comp").alias("zone"))), "token").select("zone", "k", "comp").distinct()
    at = materialize(at.withColumn("out", F.col("comp") != F.col("zone")))
    count = at.groupBy("zone").agg(F.count(F.lit(1)).alias("ny"), F.count_if("out").alias("nx"))
    count = checked_broadcast(count.select("zone", F.ceil(F.col("nx") / BLOCK_ROWS).cast("int").alias("bx"), F.ceil(F.col("ny") / BLOCK_ROWS).cast("int").alias("by")))
    at = at.join(count, "zone")
    own = lambda blocks, seed: F.pmod(F.xxhash64("k", F.lit(seed)), F.col(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    x = at.filter("out").withColumn("x", own("bx", 3)).withColumn("y", every("by")).withColumn("is_x", F.lit(True))
    y = at.withColumn("y", own("by", 4)).withColumn("x", every("bx")).withColumn("is_x", F.lit(False))
    # a row that is in both roles of one task goes there once
    dealt = x.unionByName(y).groupBy(F.col("zone").alias("token"), "x", "y", "k", "comp").agg(F.max("is_x").alias("is_x"))
    dealt = dealt.join(sets, "k").select("token", "x", "y", "k", "n", "is_x", "comp", "grams")
    dealt = dealt.repartition("token", "x", "y").sortWithinPartitions("token", "x", "y")
    return links.union(dealt.mapInPandas(_cross_multiply(percent), "a binary, b binary"))


def jaccard_components(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id that links reach) of each document.

    Words are split at ASCII white space after lower-casing A-Z. A document
    without words or text has no shingles, links with nothing and is its own
    component. Equal sets always link. Rows that repeat a doc_id are separate
    documents; a null doc_id takes part but is never the smallest. An empty
    table gives an empty table; further columns are ignored. The input must
    give the same rows in the same order when a lost task is run again, as any
    stored table does; one that doesn't ends the job with an error.
    """
    spark = docs.sparkSession
    rows = materialize(incidence_rows(docs, size, percent))
    release(spark)
    classes = rows.filter("grams is not null").groupBy("k").agg(
        F.first("n_shingles").alias("n"), F.first("grams").alias("grams"), F.first("prefix").alias("prefix"), F.count(F.lit(1)).alias("copies")
    )
    classes = materialize(classes)
    release(spark)
    label = components(class_links(classes, percent))
    smallest = rows.filter("k is not null").groupBy("k").agg(F.min("doc_id").alias("least")).join(label, "k", "left")
    smallest = smallest.withColumn("comp", F.coalesce("comp", "k"))
    by_comp = smallest.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = smallest.join(by_comp, "comp").select("k", "component_id")
    out = rows.select("doc_id", "n_shingles", "k").join(named, "k", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def without_near_copies(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component with all its columns: the smallest doc_id, null ones last.

    A document is known by 128 bits of hashes of doc_id and text, so rows that
    repeat a doc_id, or have none, are judged by their own text. Of rows that
    repeat both the first stays, in the order of all their columns, nulls first.
    Documents without words stay; those of them that have no doc_id stay as
    often as they occur. An empty table gives an empty one.
    """
    doc_id, name = F.col("doc_id").cast("long"), unused_name(docs, "_row")
    first, second = unused_name(docs, "_first"), unused_name(docs, "_second")
    hashes = {first: F.xxhash64(doc_id, F.col("text").cast("string")), second: F.xxhash64(F.col("text").cast("string"), doc_id)}
    rows = materialize(docs.select(*[h.alias(c) for c, h in hashes.items()], doc_id.alias("own")).distinct())
    # the first 64 bits name a row, but where those of two rows meet the second are mixed in
    met = materialize(rows.groupBy(first).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(first))
    known_by = lambda df: df.withColumn(name, F.col(first))
    if met.limit(1).count():
        twice = checked_broadcast(met.withColumnRenamed(first, second + "_"))
        known_by = lambda df: df.join(twice, F.col(first) == F.col(second + "_"), "left").withColumn(name, F.when(F.col(second + "_").isNull(), F.col(first)).otherwise(F.xxhash64(first, second))).drop(second + "_")
    marked = known_by(docs.withColumns(hashes)).drop(first, second)
    named = marked.select(F.col(name).alias("doc_id"), "text")
    found = materialize(jaccard_components(named, size, percent).select(F.col("doc_id").alias(name), "component_id", "n_shingles"))
    known = found.groupBy(name, "component_id", "n_shingles").agg(F.count(F.lit(1)).alias("copies"))
    known = materialize(known.join(known_by(rows).select(name, "own"), name))
    stays = known.groupBy("component_id").agg(F.min(F.struct(F.col("own").isNull(), "own", name)).alias("x")).select(f"x.{name}")
    gone = known.select(name).join(stays, name, "left_anti")
    kept = marked.join(gone, name, "left_anti")
    repeated = known.filter("copies > 1 and (n_shingles > 0 or own is not null)").select(name)
    if repeated.limit(1).count():
        order = [F.to_json(F.struct(quoted(f.name))) if "map<" in f.dataType.simpleString() else quoted(f.name) for f in docs.schema]
        again = kept.join(repeated, name, "left_semi").groupBy(name).agg(F.min_by(F.struct(*map(quoted, docs.columns)), F.struct(*order)).alias(name + "_"))
        kept = kept.join(repeated, name, "left_anti").select(docs.columns).unionByName(again.select(f"{name}_.*"))
    return kept.select(docs.columns)
