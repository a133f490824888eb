"""Document quality by hierarchical empirical Bayes.

A logistic model over simple measures of the text gives each document's own
evidence. Sites are a hierarchy: all documents, then host, then path within the
host. The good share of a host is shrunk toward the share of all, and that of a
path toward its host's posterior, the more the fewer documents it has; how far
is estimated from the spread of the shares (method of moments). A document's
posterior odds are its evidence times the prior odds of its path.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from learnlake.llm.common import checked_broadcast, materialize, small_batches, unused_name
from learnlake.llm.sampling import held_out, pick

#: Labelled documents that the evidence model is fitted on.
SAMPLE = 12_000
#: A document whose probability of being good is below this is rejected.
THRESHOLD = 0.5
#: Evidence is held between these probabilities.
LEAST, MOST = 0.001, 0.999

MEASURES = (
    "log_words", "word_length", "distinct_words", "repeats", "top_word", "upper", "digits", "symbols", "bars",
    "marks", "doubled_marks", "lines_per_word", "distinct_lines", "full_stops", "short_words", "long_words", "empty",
)


def measures(text: str | None) -> list[float]:
    """The measures of a whole text, in the order of MEASURES; those of an empty one are 0 but the last."""
    words = text.split() if text else []
    if not words:
        return [0.0] * (len(MEASURES) - 1) + [1.0]
    n, chars = len(words), len(text)
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x]
    letters = sum(map(len, words))
    plain = text.isascii()
    raw = text.encode("utf-8", "surrogatepass")
    kept = len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    symbols = len(raw) - len(raw.translate(None, b"#$%&*@^~_=+<>{}[]\\"))
    upper = (len(raw) - kept) / chars if plain else sum(map(str.isupper, text)) / chars
    lengths = np.fromiter(map(len, words), np.int64, n)
    return [
        float(np.log1p(n)),
        min(letters / n, 30.0),
        len(counts) / n,
        sum(a == b for a, b in zip(words, words[1:])) / n,
        counts.most_common(1)[0][1] / n,
        upper,
        (len(raw) - len(raw.translate(None, b"0123456789"))) / chars,
        symbols / chars,
        text.count("|") / n,
        (text.count("!") + text.count("?")) / n,
        text.count("!!") / n,
        len(lines) / n,
        len(set(lines)) / max(len(lines), 1),
        (text.count(".") + text.count(",")) / n,
        float((lengths <= 2).mean()),
        float((lengths >= 15).mean()),
        0.0,
    ]


@dataclass
class EvidenceModel:
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  #: of the scaled measures, their squares, and 1
    base: float  #: share of good documents among those learnt from

    @staticmethod
    def expand(x: np.ndarray) -> np.ndarray:
        x = np.clip(x, -6, 6)
        return np.hstack([x, x * x, np.ones((len(x), 1))])

    def probability(self, texts: list[str | None]) -> np.ndarray:
        x = np.array([measures(t) for t in texts], dtype=np.float64).reshape(-1, len(MEASURES))
        z = self.expand((x - self.centre) / self.scale) @ self.weights
        return np.clip(1 / (1 + np.exp(-np.clip(z, -30, 30))), LEAST, MOST)


def fit_evidence(x: np.ndarray, good: np.ndarray, rounds: int = 30, ridge: float = 1.0) -> EvidenceModel:
    """Logistic regression by Newton's method. Without both kinds of label the evidence says nothing."""
    base = float(np.clip(good.mean(), 0.01, 0.99)) if len(good) else 0.5
    n = len(MEASURES)
    if len(good) == 0 or good.min() == good.max():
        w = np.zeros(2 * n + 1)
        w[-1] = np.log(base / (1 - base))
        return EvidenceModel(np.zeros(n), np.ones(n), w, base)
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    a = EvidenceModel.expand((x - centre) / scale)
    penalty = np.full(a.shape[1], ridge)
    penalty[-1] = 1e-6
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p) + 1e-6)[:, None]).T @ a + np.diag(penalty)
        step = np.linalg.solve(h, a.T @ (good - p) - penalty * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return EvidenceModel(centre, scale, w, base)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> EvidenceModel:
    """Fits the evidence on at most ``sample`` labelled documents that aren't held out.

    Of several labels of a document the worst counts; null labels don't. Of
    rows that repeat a doc_id the one with the smallest hash of its text is
    learnt from, so that the sample's bound is one of rows.
    """
    small_batches(docs.sparkSession)
    known = labels.filter(~held_out(F.col("doc_id")) & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    ids = pick(known, sample)
    chosen = known.join(F.broadcast(ids), "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") > 0).cast("int").alias("good"))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "good": frame["good"], "x": [measures(t) for t in frame["text"]]})

    one = plain.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "good").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("x"))
    rows = one.select("doc_id", "good", F.col("x.text").alias("text")).mapInPandas(run, "doc_id long, good int, x array<double>").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["x"]))
    x = np.array([r["x"] for r in rows], dtype=np.float64).reshape(-1, len(MEASURES))
    return fit_evidence(x, np.array([r["good"] for r in rows], dtype=np.float64))


def evidence(docs: DataFrame, model: EvidenceModel, host: Column, path: Column) -> DataFrame:
    """doc_id, host, path and own probability of each document."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.drop(columns="text").assign(own=shared.value.probability(frame["text"].tolist()))

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), host.cast("string").alias("host"), path.cast("string").alias("path"), F.col("text").cast("string").alias("text"))
    return plain.mapInPandas(run, "doc_id long, host string, path string, own double")


def _strength(shares: DataFrame, prior: Column) -> DataFrame:
    """One row: how many documents the prior is worth, from columns n and s (sum of probabilities).

    The spread of the shares around their prior, less what sampling alone
    gives, is the variance between sites; without any, the prior is worth a
    million documents.
    """
    p = F.col("s") / F.col("n")
    weight = F.col("n")
    noise = prior * (1 - prior) / F.col("n")
    between = F.greatest(F.sum(weight * ((p - prior) * (p - prior) - noise)) / F.sum(weight), F.lit(0.0))
    level = F.sum(weight * prior * (1 - prior)) / F.sum(weight)
    worth = F.greatest(F.least(level / F.greatest(between, F.lit(1e-12)) - 1, F.lit(1e6)), F.lit(1.0))
    return shares.agg(worth.alias("worth"))


def site_posteriors(scored: DataFrame) -> DataFrame:
    """host, path and the posterior good share of the path; null hosts and paths are sites of their own."""
    paths = materialize(scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("own").alias("s")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    total = hosts.agg(F.sum("s") / F.sum("n")).first()[0]
    overall = float(np.clip(0.5 if total is None else total, LEAST, MOST))
    worth = _strength(hosts, F.lit(overall)).first()[0] or 1.0
    hosts = hosts.select(F.col("host").alias("of_host"), ((F.col("s") + worth * overall) / (F.col("n") + worth)).alias("host_share"))
    joined = paths.join(hosts, F.col("host").eqNullSafe(F.col("of_host"))).select("host", "path", "n", "s", "host_share")
    worth = _strength(joined, F.col("host_share")).first()[0] or 1.0
    share = (F.col("s") + worth * F.col("host_share")) / (F.col("n") + worth)
    return joined.select("host", "path", F.least(F.greatest(share, F.lit(LEAST)), F.lit(MOST)).alias("site_share"))


def _posterior(own: Column, site: Column, base: float) -> Column:
    odds = F.log(own / (1 - own)) - F.lit(float(np.log(base / (1 - base)))) + F.log(site / (1 - site))
    return 1 / (1 + F.exp(-odds))


def classify(docs: DataFrame, model: EvidenceModel, host: Column, path: Column) -> DataFrame:
    """doc_id, host, path, own (evidence), site_share, quality (posterior) and accepted of each document.

    An empty or null text is measured as empty. A document without host or path
    belongs to the site of those without. Repeated rows count as often as they
    occur. An empty table gives an empty table.
    """
    scored = materialize(evidence(docs, model, host, path))
    sites = checked_broadcast(site_posteriors(scored)).alias("site")
    at = F.col("d.host").eqNullSafe(F.col("site.host")) & F.col("d.path").eqNullSafe(F.col("site.path"))
    joined = scored.alias("d").join(sites, at).select("d.*", "site.site_share")
    joined = joined.withColumn("quality", _posterior(F.col("own"), F.col("site_share"), model.base))
    return joined.withColumn("accepted", F.col("quality") >= THRESHOLD)


def accepted_documents(docs: DataFrame, model: EvidenceModel, host: Column, path: Column) -> DataFrame:
    """The accepted documents with all their columns.

    The text stays where it is: its evidence is computed again beside the
    sites' posteriors, which the first pass has gathered. An empty or null text
    is measured as empty; null hosts and paths are sites of their own; repeated
    rows stay or go together; further columns stay, whatever their names.
    """
    scored = evidence(docs, model, host, path)
    sites = checked_broadcast(site_posteriors(scored))
    names = [unused_name(docs, x) for x in ("site_host", "site_path", "site_share")]
    sites = sites.toDF(*names)
    joined = docs.join(sites, host.cast("string").eqNullSafe(F.col(names[0])) & path.cast("string").eqNullSafe(F.col(names[1])))
    columns, share = docs.columns, names[2]
    shared, shift = docs.sparkSession.sparkContext.broadcast(model), float(np.log(model.base / (1 - model.base)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            own, site = shared.value.probability(frame["text"].tolist()), frame[share].to_numpy()
            odds = np.log(own / (1 - own)) - shift + np.log(site / (1 - site))
            yield frame.loc[1 / (1 + np.exp(-odds)) >= THRESHOLD, columns]

    return joined.select(*columns, share).mapInPandas(run, docs.schema)
