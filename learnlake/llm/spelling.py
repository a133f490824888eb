"""Spelling variants: words one edit apart, found by merging an errata trie.

The vocabulary's trie is cut into heavy paths: a node's heavy child is the one
with most words below it. At each node the light subtrees are merged into the
heavy one, each of their words as it reads with the character that leads into
the subtree replaced by the heavy one, with the heavy one put in before it, or
with it skipped. Where the result coincides with a terminal, the two words are
one edit apart. Light words that are the same but for the character met here
coincide with each other under one pattern. A word lies in a light subtree at
no more than log2(words) nodes, so it has few errata, whatever its length.

Every pair meets: at the node where two words part, one of them is light. If
they differ by a replaced character there, they share the pattern; if one has
a character more, it is skipped from the longer word where that is light, else
the longer one is the heavy one and the shorter reads as it does with the heavy
character put in. That holds for any choice of the heavy child, so nodes may
be told apart by hashes; only whole words decide what coincides.

Nodes near the root hold a large share of all words. They are few, as at most
``HOT_SHARE`` nodes of one depth hold that share of the words each, and go to
all tasks; the words of any other node are at most that share.

Rules: null texts have no words; words of any length are taken whole (each
character gives one row of fixed width); ties go to the smallest word in code-
point order; repeated rows count each; an empty table gives an empty one.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from learnlake.llm.common import checked_broadcast, materialize, mix64, small_batches

#: Letters of words: ASCII and Latin-1 from U+00C0 on.
LETTERS = "A-Za-zÀ-ÿ"
#: Where this divides the CRC-32 of ``doc_id:run``, one character of the run is lost.
LOSS = 199
MIN_LENGTH, MIN_COUNT, MIN_RATIO = 6, 5, 5
#: Distinct words that a task counts before it passes them on.
HELD_WORDS = 200_000
#: A node is hot if it holds more than this part of all words, and at least so many.
HOT_SHARE, HOT_WORDS = 1000, 10_000
#: Factor of the prefix hash; the end of a word counts as the character -1.
FACTOR, END = np.uint64(0x9E3779B97F4A7C15), -1

_LOWER = {c: c + 32 for c in range(65, 91)}


def runs_of(text: str, letters: str = LETTERS) -> list[str]:
    """The runs of letters of a text, A-Z as a-z."""
    return re.findall(f"[{letters}]+", text.translate(_LOWER))


def as_read(doc_id: object, run: str, loss: int = LOSS) -> str:
    """A document's run as it is read: every loss-th one lacks a character."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    return run if h % loss else run[: h % len(run)] + run[h % len(run) + 1 :]


def count_words(docs: DataFrame, letters: str = LETTERS, loss: int = LOSS, length: int = MIN_LENGTH) -> DataFrame:
    """word, n: how often each word of enough letters is read in the texts."""
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for run, n in Counter(runs_of(text.as_py(), letters)).items():
                    if len(run) >= length and len(word := as_read("" if doc_id is None else doc_id, run, loss)) >= length:
                        held[word] += n
                if len(held) > HELD_WORDS:
                    yield counted(held)
                    held = Counter()
        yield counted(held)

    found = docs.filter("text is not null").select("doc_id", "text").mapInArrow(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def counted(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])


def prefixes(words: DataFrame) -> DataFrame:
    """A row (id, at, node, letter) for each node on each word's path: its depth, its hash, and the character that leads on."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, first = batch.column(0).to_numpy(), 0
            texts = batch.column(1).to_pylist()
            while first < len(texts):  # as many words at a time as have some 100,000 characters, one at least
                last, letters = first + 1, len(texts[first])
                while last < len(texts) and letters < 100_000:
                    letters += len(texts[last])
                    last += 1
                yield walked(ids[first:last], texts[first:last])
                first = last

    return words.select("id", "word").mapInArrow(walk, "id long, at int, node long, letter int")


def walked(ids: np.ndarray, texts: list[str]) -> pa.RecordBatch:
    """The paths of some words. A prefix's hash is the sum of its characters times powers of FACTOR, mixed."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    at = np.arange(len(points)) - np.repeat(starts[:-1], sizes)
    with np.errstate(over="ignore"):
        powers = np.concatenate(([np.uint64(1)], np.cumprod(np.full(int(sizes.max()), FACTOR)))).astype(np.uint64)
        sums = np.concatenate(([np.uint64(0)], np.cumsum((points + np.uint64(1)) * powers[at], dtype=np.uint64)))
        # one node more than characters: the last one's letter is the end
        owner = np.repeat(np.arange(len(texts)), sizes + 1)
        depth = np.arange(len(owner)) - np.repeat(starts[:-1] + np.arange(len(texts)), sizes + 1)
        node = mix64(sums[starts[owner] + depth] - sums[starts[owner]] + depth.astype(np.uint64) * powers[1])
    letter = np.full(len(owner), END, np.int32)
    inner = depth < sizes[owner]
    letter[inner] = points[(starts[owner] + depth)[inner]]
    return pa.RecordBatch.from_arrays([pa.array(ids[owner]), pa.array(depth.astype(np.int32)), pa.array(node.view(np.int64)), pa.array(letter)], ["id", "at", "node", "letter"])


def light_edges(words: DataFrame) -> DataFrame:
    """id, edges: the nodes at which a word isn't in the heavy subtree, as (at, heavy)."""
    steps = prefixes(words)
    children = steps.groupBy("node", "letter").agg(F.count(F.lit(1)).alias("below"))
    heavy = children.groupBy("node").agg(F.max_by("letter", F.struct("below", "letter")).alias("heavy"), F.sum("below").alias("below"), F.count(F.lit(1)).alias("kinds"))
    character = F.decode(F.unhex(F.lpad(F.hex("heavy"), 8, "0")), "UTF-32")
    heavy = materialize(heavy.filter("kinds > 1").withColumn("put", character).drop("kinds"))
    hot = max(words.count() // HOT_SHARE, HOT_WORDS)
    few, many = checked_broadcast(heavy.filter(F.col("below") > hot)), heavy.filter(F.col("below") <= hot)
    at_hot = steps.join(few, "node").filter("heavy != letter").select("id", "at", "put")
    rest = steps.join(few, "node", "left_anti").join(many, "node").filter("heavy != letter").select("id", "at", "put")
    return at_hot.unionByName(rest).groupBy("id").agg(F.collect_list(F.struct("at", "put")).alias("edges"))


def errata(words: DataFrame) -> DataFrame:
    """word, n, kind, text, pattern: what a word reads as at its light edges. Kinds: replaced, put in, skipped."""
    edges = words.join(light_edges(words), "id").select("word", "n", F.inline("edges").alias("at", "put"))
    head = F.substring("word", F.lit(1), F.col("at"))
    rest = F.substring("word", F.col("at") + 1, F.length("word"))
    tail = F.substring("word", F.col("at") + 2, F.length("word"))
    parts = edges.select("word", "n", head.alias("head"), rest.alias("rest"), tail.alias("tail"), "put")
    inside = F.col("rest") != ""

    def read(kind: str, *text: str) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.concat(*text).alias("text"))

    reads = F.array(read("put in", "head", "put", "rest"), F.when(inside, read("replaced", "head", "put", "tail")), F.when(inside, read("skipped", "head", "tail")))
    pattern = F.when(inside, F.concat("head", F.lit("\0"), "tail"))
    rows = parts.select("word", "n", pattern.alias("pattern"), F.explode(reads).alias("r")).filter("r is not null")
    return rows.select("word", "n", "r.kind", "r.text", F.when(F.col("r.kind") == "replaced", F.col("pattern")).alias("pattern"))


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, best: how many words are one edit from each, and the most frequent of them as (-n, word)."""
    read = materialize(errata(words))
    met = materialize(read.join(words.select(F.col("word").alias("text"), F.col("n").alias("text_n")), "text"))
    rank = lambda n, word: F.struct((-F.col(n)).alias("n"), F.col(word).alias("word"))
    # of one pattern there is at most one word a letter
    light = read.filter("kind = 'replaced'").select("pattern", rank("n", "word").alias("member"))
    heavy = met.filter("kind = 'replaced'").select("pattern", rank("text_n", "text").alias("member"))
    groups = light.unionByName(heavy).groupBy("pattern").agg(F.sort_array(F.collect_set("member")).alias("members")).filter(F.size("members") > 1)
    members = groups.select("members", F.posexplode("members").alias("k", "member"))
    best = F.when(F.col("k") == 0, F.element_at("members", 2)).otherwise(F.element_at("members", 1))
    same = members.select(F.col("member.word").alias("word"), (F.size("members") - 1).cast("long").alias("n_near"), best.alias("best"))
    longer = F.col("kind") == "put in"
    own, other = rank("n", "word"), rank("text_n", "text")
    pairs = met.filter("kind != 'replaced'").select(F.when(longer, own).otherwise(other).alias("short"), F.when(longer, other).otherwise(own).alias("long")).distinct()
    both = F.array(F.struct(F.col("short").alias("a"), F.col("long").alias("b")), F.struct(F.col("long").alias("a"), F.col("short").alias("b")))
    edited = pairs.select(F.inline(both)).select(F.col("a.word").alias("word"), F.lit(1).cast("long").alias("n_near"), F.col("b").alias("best"))
    return same.unionByName(edited).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the end of each word's chain of forms (word, form), by doubling. Forms are so much more frequent that no chain is a circle or long."""
    jumps = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        further = jumps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if jumps.join(further, "root", "left_semi").isEmpty():
            return jumps
        jumps = materialize(jumps.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")))


def variants(docs: DataFrame, letters: str = LETTERS, loss: int = LOSS, length: int = MIN_LENGTH, least: int = MIN_COUNT, ratio: int = MIN_RATIO) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word of ``length`` characters and ``least`` occurrences.

    Two such words are near if one inserted, deleted or replaced character makes
    one of the other. The form is the most frequent near word if it occurs at least
    ``ratio`` times as often, the root the last of the forms' forms.
    """
    if ratio < 2:
        raise ValueError("forms must be more frequent than their variants, else chains could be circles")
    words = materialize(count_words(docs, letters, loss, length).filter(F.col("n") >= least).withColumn("id", F.monotonically_increasing_id()))
    known = words.drop("id").join(near_words(words), "word", "left")
    formed = -F.col("best.n") >= F.col("n") * ratio
    known = known.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("best.word")).alias("form"), F.when(formed, -F.col("best.n")).alias("form_n")
    )
    known = materialize(known)
    ends = roots(known.filter("form is not null").select("word", "form"))
    return known.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
