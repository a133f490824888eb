"""Stupid-backoff language-model scores, computed relationally.

The n-gram count tables live in partitions of the n-grams' hash. A batch of
documents explodes its n-grams, asks each partition once for each distinct one,
and gets back the counts of the whole corpus, in the order in which it asked:
the join of the exploded n-grams with the count tables, without a row for every
occurrence. The scores are then summed per document.

With c the count in all other documents (a document is no evidence for itself),
the score of a word after its context is c(context word) / c(context) for the
longest context that was seen, times ``backoff`` for every shorter context that
was resorted to. A lone word has max(c(word), unseen) / N, N being the number
of words of the other documents.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from learnlake.llm.common import by_range, hash_ranges, lower_words, materialize, mix64, release, small_batches
from learnlake.llm.ngram_join import WordHashes, pack_sorted, unpack_sorted

ORDER = 2
BACKOFF = 0.4
UNSEEN = 0.5
#: Documents and characters of a batch.
BATCH_DOCS, BATCH_CHARS = 4_000, 5_000_000

_ROW = "batch string, p int, kind int, grams binary, counts binary"
_COLUMNS = ["batch", "p", "kind", "grams", "counts"]


def ngrams(texts: list[str | None], order: int, known: WordHashes) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Document and place of each word, and for k = 1 to order the hash of the k-gram that ends there (0 where none does)."""
    words, start = [], [0]
    for text in texts:
        words += map(known.__getitem__, lower_words(text))
        start.append(len(words))
    count = np.diff(start)
    doc = np.repeat(np.arange(len(texts)), count)
    place = np.arange(len(words)) - np.repeat(np.array(start[:-1]), count)
    one = np.array(words, np.uint64)
    grams = [mix64(one | np.uint64(1))] if len(one) else [one]
    with np.errstate(over="ignore"):
        for k in range(1, order):
            h = np.zeros(len(one), np.uint64)
            h[k:] = mix64(grams[-1][:-1][k - 1 :] * np.uint64(0x9E3779B97F4A7C15) + one[k:] + np.uint64(k)) if len(one) > k else 0
            h[place < k] = 0
            grams.append(h)
    return doc, place, grams


def _batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        chars = frame["text"].str.len().fillna(0).to_numpy().cumsum()
        part = np.maximum(chars // BATCH_CHARS, np.arange(len(frame)) // BATCH_DOCS)
        edges = np.flatnonzero(np.diff(part, prepend=-1) != 0)
        for lo, hi in zip(edges, [*edges[1:], len(frame)]):
            yield frame.iloc[lo:hi]


def _distinct(grams: list[np.ndarray]) -> np.ndarray:
    every = np.concatenate(grams)
    return every[every != 0]


def _ask(order: int, parts: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard
        from pyspark import TaskContext

        task, known = TaskContext.get().partitionId(), WordHashes()
        bounds = np.array([-(-(p << 64) // parts) for p in range(1, parts)], dtype=np.uint64)
        for number, frame in enumerate(_batches(frames)):
            texts = frame["text"].tolist()
            gram, count = np.unique(_distinct(ngrams(texts, order, known)[2]), return_counts=True)
            frame = frame.assign(text=[None if t is None else t.encode("utf-8", "surrogatepass") for t in texts])
            held = zstandard.compress(b"".join(t or b"" for t in frame["text"]), 3)
            sizes = np.array([-1 if t is None else len(t) for t in frame["text"]], np.int64)
            ids = frame["doc_id"]
            head = np.concatenate([ids.notna().to_numpy().astype(np.int64), ids.fillna(0).astype(np.int64).to_numpy(), sizes])
            name = f"{task}-{number}-{hashlib.sha1(held + head.tobytes()).hexdigest()[:16]}"
            at = [0, *np.searchsorted(gram, bounds), len(gram)]
            rows = [(name, p, 1, pack_sorted(gram[a:b]), count[a:b].astype("<u4").tobytes()) for p, (a, b) in enumerate(zip(at, at[1:])) if a < b]
            rows.append((name, zlib.crc32(name.encode()) % parts, 0, held, np.concatenate([[len(rows)], head]).astype(np.int64).tobytes()))
            yield pd.DataFrame(rows, columns=_COLUMNS)

    return run


def _count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Answers each request with the corpus counts; they come in the order of their range, of which one is held at a time."""
    asked: list[tuple] = []
    for frame in frames:
        own = frame["kind"] == 0
        if own.any():
            yield frame[own]
        for row in frame.loc[~own, ["batch", "p", "grams", "counts"]].itertuples(index=False, name=None):
            if asked and asked[0][1] != row[1]:
                yield _answers(asked)
                asked = []
            asked.append(row)
    if asked:
        yield _answers(asked)


def _answers(asked: list[tuple]) -> pd.DataFrame:
    grams = [unpack_sorted(g) for _, _, g, _ in asked]
    _, at = np.unique(np.concatenate(grams), return_inverse=True)
    total = np.zeros(at.max() + 1, np.int64)
    np.add.at(total, at, np.concatenate([np.frombuffer(c, "<u4") for *_, c in asked]))
    found = np.split(total[at], np.cumsum([len(g) for g in grams])[:-1])
    return pd.DataFrame([(name, p, 2, b"", counts.astype("<i8").tobytes()) for (name, p, _, _), counts in zip(asked, found)], columns=_COLUMNS)


def _score(order: int, backoff: float, unseen: float):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        import zstandard

        frame = frame.sort_values("p")
        own, answers = frame[frame["kind"] == 0], frame[frame["kind"] == 2]
        if len(own) != 1 or np.frombuffer(own["counts"].iloc[0], np.int64, 1)[0] != len(answers):
            raise ValueError(f"batch {frame['batch'].iloc[0]}: the input gave other rows when a lost task ran again")
        text = own.iloc[0]
        has_id, ids, sizes = np.frombuffer(text["counts"], np.int64)[1:].reshape(3, -1)
        raw, at, texts = zstandard.decompress(text["grams"]), 0, []
        for n in sizes.tolist():
            texts.append(None if n < 0 else raw[at : at + n].decode("utf-8", "surrogatepass"))
            at += max(n, 0)
        total = np.concatenate([np.frombuffer(c, "<i8") for c in answers["counts"]] or [np.empty(0, np.int64)])
        doc, place, grams = ngrams(texts, order, WordHashes())
        gram = np.unique(_distinct(grams))
        total = np.append(total, 0)  # the last entry stands for no n-gram
        left = []  # counts in other documents, by length of the n-gram
        for h in grams:
            index = np.searchsorted(gram, h)
            index[h == 0] = len(gram)
            _, pair, own = np.unique(doc * (len(gram) + 1) + index, return_inverse=True, return_counts=True)
            left.append(np.where(h == 0, 0, total[index] - own[pair]))
        score = np.full(len(doc), np.nan)
        lone = np.zeros(len(doc), bool)
        longest = np.minimum(place + 1, order)
        for k in range(order, 0, -1):
            steps = np.log(backoff) * (longest - k)
            if k > 1:
                context = np.concatenate([np.zeros(1, np.int64), left[k - 2][:-1]])
                use = np.isnan(score) & (left[k - 1] > 0)
                score[use] = steps[use] + np.log(left[k - 1][use] / context[use])
            else:
                lone = np.isnan(score)
                score[lone] = steps[lone] + np.log(np.maximum(left[0][lone], unseen))
        n = len(texts)
        out = pd.DataFrame({
            "doc_id": pd.array([int(i) if h else None for h, i in zip(has_id, ids)], dtype="Int64"),
            "n_words": np.bincount(doc, minlength=n),
            "part": np.bincount(doc, weights=score, minlength=n),
            "n_lone": np.bincount(doc, weights=lone, minlength=n).astype(np.int64),
        })
        return out

    return run


def score_documents(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF, unseen: float = UNSEEN) -> DataFrame:
    """doc_id, n_words, log_score (natural logarithm, summed over the words) and mean_log_score of each document.

    Words are split at ASCII white space after lower-casing A-Z; n-grams don't
    reach over documents. A document without words or text scores 0 in 0 words
    and has no mean. Where there is no other document N counts as 1. Repeated
    rows are other documents to each other. Further columns are ignored. As for
    any stored table, a lost task must find the same rows when it runs again;
    should it not, the job ends with an error.
    """
    spark = docs.sparkSession
    small_batches(spark)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts, ranges = hash_ranges(plain)
    counted = by_range(plain.mapInPandas(_ask(order, ranges), _ROW), parts, ranges).mapInPandas(_count, _ROW)
    sums = counted.repartition(parts, "batch").groupBy("batch").applyInPandas(_score(order, backoff, unseen), "doc_id long, n_words long, part double, n_lone long")
    sums = materialize(sums)
    release(spark)
    total = sums.agg(F.sum("n_words")).first()[0] or 0
    others = F.greatest(F.lit(total) - F.col("n_words"), F.lit(1))
    score = F.col("part") - F.col("n_lone") * F.log(others.cast("double"))
    return sums.select("doc_id", "n_words", score.alias("log_score"), F.try_divide(score, F.col("n_words")).alias("mean_log_score"))
