"""Benchmark decontamination with an Aho-Corasick automaton.

Each benchmark item gives its windows of consecutive words, written with one
space between and around the words; all windows of all items make one
automaton. A document's words, written likewise, are scanned once. A match
ends at a known byte, which leads to the word and, over the byte positions
that translation leaves as they are, to the place in the original text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from learnlake.llm.common import ALNUM_LOWER, materialize, small_batches, unused_name

WINDOW = 10
#: Characters of windows that one automaton takes, about; a larger benchmark is scanned for in several passes.
AUTOMATON_CHARS = 4_000_000


def _words(text: str | None) -> list[bytes]:
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(ALNUM_LOWER).split()


def item_windows(text: str | None, window: int = WINDOW) -> list[str]:
    """An item's windows, as the automaton takes them: each byte one character."""
    words = _words(text)
    return [f" {b' '.join(words[k : k + window]).decode('latin-1')} " for k in range(max(1, len(words) - window + 1))] if words else []


def windows_of(items: list[tuple[int, str | None]], window: int = WINDOW) -> dict[str, list[int]]:
    """The items of each window; an item without an id has none."""
    owners: dict[str, set[int]] = {}
    for item_id, text in items:
        if item_id is not None:
            for w in item_windows(text, window):
                owners.setdefault(w, set()).add(item_id)
    return {w: sorted(owners[w]) for w in sorted(owners)}


@dataclass
class Hits:
    n_words: int
    words: list[tuple[int, int]]  #: hit words, as merged ranges of word numbers
    items: set[int]

    @property
    def n_hit(self) -> int:
        return sum(e - s for s, e in self.words)


class Scanner:
    def __init__(self, windows: dict[str, list[int]]):
        import ahocorasick

        self.automaton = None
        if windows:
            self.automaton = ahocorasick.Automaton()
            for w, owners in windows.items():
                self.automaton.add_word(w, (w.count(" ") - 1, owners))
            self.automaton.make_automaton()

    def scan(self, text: str | None) -> Hits:
        words = _words(text)
        if not words or not self.automaton:
            return Hits(len(words), [], set())
        line = f" {b' '.join(words).decode('latin-1')} "
        ends: list[int] = []
        sizes: list[int] = []
        items: set[int] = set()
        for end, (n, owners) in self.automaton.iter(line):
            ends.append(end)
            sizes.append(n)
            items.update(owners)
        if not ends:
            return Hits(len(words), [], items)
        spaces = np.flatnonzero(np.frombuffer(line.encode("latin-1"), dtype=np.uint8) == 32)
        stop = np.searchsorted(spaces, np.array(ends))  # the space behind word k has number k + 1
        return Hits(len(words), merged(zip((stop - np.array(sizes)).tolist(), stop.tolist()), len(words)), items)


def merged(ranges: Iterable[tuple[int, int]], n_words: int) -> list[tuple[int, int]]:
    """Ranges of word numbers, united where they meet or overlap."""
    ranges = np.array(list(ranges), dtype=np.int64).reshape(-1, 2)
    marks = np.zeros(n_words + 1, np.int64)
    np.add.at(marks, ranges[:, 0], 1)
    np.add.at(marks, ranges[:, 1], -1)
    edge = np.diff(np.concatenate([[0], np.cumsum(marks[:-1]) > 0, [0]]).astype(np.int8))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))


def char_spans(text: str, words: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """For each range of word numbers, first and last-plus-one character of the original."""
    if not words:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    inside = np.frombuffer(raw.translate(ALNUM_LOWER), dtype=np.uint8)
    inside = ~np.isin(inside, np.frombuffer(b" \t\n\v\f\r", dtype=np.uint8))
    edge = np.diff(np.concatenate([[0], inside, [0]]).astype(np.int8))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    char = np.concatenate([[0], np.cumsum((np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80)])
    return [(int(char[first[s]]), int(char[last[e - 1]])) for s, e in words]


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    for s, e in reversed(spans):
        text = text[:s] + text[e:]
    return text


def benchmark_parts(benchmark: DataFrame, window: int = WINDOW) -> list[DataFrame]:
    """The benchmark's items by parts whose windows make one automaton each; a part is collected on its own."""
    plain = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    chars = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-chars * window // AUTOMATON_CHARS) or 1
    return [plain.filter(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k) for k in range(parts)]


def _scan(windows, names: list[str], first: bool, finish):
    """One pass: hits so far, from the columns ``names`` (words, items) unless it is the first, and those of ``windows``.

    ``finish`` gets the frame, its rows' hits, and the scan itself.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(windows.value)
        for frame in frames:
            found = [scanner.scan(t) for t in frame["text"]]
            if not first:
                for hits, words, items in zip(found, frame[names[0]], frame[names[1]]):
                    hits.words = merged([*hits.words, *((w["s"], w["e"]) for w in words)], hits.n_words)
                    hits.items.update(int(i) for i in items)
                frame = frame.drop(columns=names)
            yield finish(frame, found, scanner.scan)

    return run


def _scanned(docs: DataFrame, parts: list[DataFrame], window: int, finish, schema: str) -> DataFrame:
    """What ``finish`` makes of a frame of docs and its rows' hits over all parts of a benchmark.

    Each part of the benchmark is one pass over the rows, which stay where they
    are. Between two passes they are written to the shared folder, so that a
    task holds one automaton at a time.
    """
    small_batches(docs.sparkSession)
    names = [unused_name(docs, "hit_words"), unused_name(docs, "hit_items")]
    carried = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + [f"`{names[0]}` array<struct<s:long,e:long>>, `{names[1]}` array<long>"])

    def carry(frame: pd.DataFrame, found: list[Hits], _) -> pd.DataFrame:
        return frame.assign(**{names[0]: [[{"s": s, "e": e} for s, e in h.words] for h in found], names[1]: [sorted(h.items) for h in found]})

    for k, part in enumerate(parts):
        last = k == len(parts) - 1
        windows = docs.sparkSession.sparkContext.broadcast(windows_of([tuple(r) for r in part.collect()], window))
        docs = docs.mapInPandas(_scan(windows, names, k == 0, finish if last else carry), schema if last else carried)
        docs = docs if last else materialize(docs)
    return docs


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, item_ids and spans (characters of the original) of each document.

    A null or empty text, or one without words, has no words and no hits;
    items without words or without item_id hit nothing; repeated rows are each
    scanned. Rows stay where they are: nothing is shuffled.
    """

    def finish(frame: pd.DataFrame, found: list[Hits], _) -> pd.DataFrame:
        spans = [[{"start": s, "end": e} for s, e in char_spans(t, h.words)] for t, h in zip(frame["text"], found)]
        rows = [(i, h.n_words, h.n_hit, sorted(h.items), s) for i, h, s in zip(frame["doc_id"], found, spans)]
        return pd.DataFrame(rows, columns=["doc_id", "n_words", "n_hit", "item_ids", "spans"]).astype({"doc_id": "Int64"})

    schema = "doc_id long, n_words long, n_hit long, item_ids array<long>, spans array<struct<start:long,end:long>>"
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _scanned(plain, benchmark_parts(benchmark, window), window, finish, schema)


def items_digest(item_ids: list[int]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, item_ids))).encode()).hexdigest()


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents with all their columns, benchmark passages cut out of the texts.

    What closes up over a cut is scanned again until nothing is hit. A document
    of which nothing but separators is left goes; one that had no hit is
    returned as it was, nulls included; ``n_chars``, if there is such a column,
    follows the text. Repeated rows are cut alike.
    """
    mark, parts = unused_name(docs, "was_cut"), benchmark_parts(benchmark, window)
    alone = len(parts) == 1

    def finish(frame: pd.DataFrame, found: list[Hits], scan) -> pd.DataFrame:
        cut, again = [], []
        for text, hits in zip(frame["text"], found):
            while hits.words:
                text = without_spans(text, char_spans(text, hits.words))
                if not alone:
                    break
                hits = scan(text)
            cut.append(text)
            again.append(bool(hits.words))
        touched = [bool(h.words) for h in found]
        if "n_chars" in frame:
            frame["n_chars"] = [len(c) if t else n for n, c, t in zip(frame["n_chars"], cut, touched)]
        frame = frame.assign(text=cut, **{mark: again})
        return frame[[not t or bool(_words(c)) for c, t in zip(cut, touched)]]

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + [f"`{mark}` boolean"])
    if alone:
        return _scanned(docs, parts, window, finish, schema).drop(mark)
    done = []
    while True:  # what was cut goes round again
        scanned = materialize(_scanned(docs, parts, window, finish, schema))
        done.append(scanned.filter(~F.col(mark)).drop(mark))
        docs = scanned.filter(mark).drop(mark)
        if not docs.limit(1).count():
            return reduce(DataFrame.unionByName, done)
