"""Approximate nearest neighbours by inner product with anisotropic quantisation.

Codes have four bits for each component of a vector. The quantiser is
score-aware: of the residual, the part parallel to the vector changes the inner
product with the very queries for which the vector scores high, so it is
penalised ``eta`` times as much as the rest (Guo et al., 2020). What is coded is
the vector's difference from its coarse centre, in units of the centre's spread,
so that vectors which nearly coincide are still told apart. A scan adds up table
entries, two codes a byte; only codes are dealt out to it. The best by code of
all vectors are then joined with their vectors and scored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from learnlake.llm.common import materialize

#: Vectors that the codebooks are fitted on.
SAMPLE = 8_000
CENTRES = 16
SUB = 1
#: Score from which on (as a share of the norm) a query counts for the loss.
SCORE_SHARE = 0.2
#: Candidates that are scored exactly, for each neighbour asked for (README: recall as measured).
OVERSAMPLE = 5
#: Coarse centres.
COARSE = 64
#: Vectors of a data block (held as codes) and queries that are dealt out together.
BLOCK, QUERY_BLOCK = 65_536, 1_024


@dataclass
class Quantiser:
    coarse: np.ndarray  #: coarse centres x padded dimension
    spread: np.ndarray  #: of each coarse centre
    books: np.ndarray  #: subspaces x CENTRES x SUB
    eta: float

    def pad(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, self.coarse.shape[1] - x.shape[1]))).astype(np.float32)

    def parts(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Coarse centre, scaled difference and direction of each vector, the latter two by subspace."""
        x = self.pad(x)
        near = np.argmax(x @ self.coarse.T - 0.5 * (self.coarse**2).sum(1), axis=1)
        shape = (len(x), -1, SUB)
        unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
        return near, ((x - self.coarse[near]) / self.spread[near, None]).reshape(shape), unit.reshape(shape)

    def code(self, parts: np.ndarray, units: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
        """Codes and the residual's part along the vector, by subspace: nearest centres
        first, then ``rounds`` times each subspace anew with the others fixed."""
        rows, subs = parts.shape[:2]
        code, along = np.empty((rows, subs), np.uint8), np.empty((rows, subs), np.float32)
        far = [((parts[:, s, None, :] - self.books[s]) ** 2).sum(-1) for s in range(subs)]
        side = [(units[:, s] * parts[:, s]).sum(-1)[:, None] - units[:, s] @ self.books[s].T for s in range(subs)]
        take = np.arange(rows)
        for turn in range(rounds + 1):
            total = along.sum(1) if turn else None
            for s in range(subs):
                if turn:
                    rest = total - along[:, s]
                    code[:, s] = (far[s] + (self.eta - 1) * (rest[:, None] + side[s]) ** 2).argmin(1)
                    along[:, s] = side[s][take, code[:, s]]
                    total = rest + along[:, s]
                else:
                    code[:, s] = far[s].argmin(1)
                    along[:, s] = side[s][take, code[:, s]]
        return code, along

    def encode(self, x: np.ndarray, rounds: int = 2) -> tuple[np.ndarray, np.ndarray]:
        """Coarse centres and codes."""
        near, parts, units = self.parts(x)
        return near, self.code(parts, units, rounds)[0]

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Queries x byte positions x 256: what two codes of a byte add to the score."""
        q = self.pad(q).reshape(len(q), -1, SUB)
        one = np.einsum("qsd,scd->qsc", q, self.books)
        if one.shape[1] % 2:
            one = np.concatenate([one, np.zeros((len(one), 1, CENTRES), one.dtype)], axis=1)
        return (one[:, 0::2, :, None] + one[:, 1::2, None, :]).reshape(len(q), -1, CENTRES * CENTRES).astype(np.float32)


def packed(code: np.ndarray) -> np.ndarray:
    """Two codes a byte, byte positions first."""
    if code.shape[1] % 2:
        code = np.concatenate([code, np.zeros((len(code), 1), np.uint8)], axis=1)
    return np.ascontiguousarray((code[:, 0::2] * CENTRES + code[:, 1::2]).T)


def coarse_centres(x: np.ndarray, rng: np.random.Generator, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """k-means centres and the root mean square distance, a component, of the vectors at each."""
    centres = x[rng.choice(len(x), min(COARSE, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = np.argmax(x @ centres.T - 0.5 * (centres**2).sum(1), axis=1)
        for c in range(len(centres)):
            if (own := near == c).any():
                centres[c] = x[own].mean(0)
    near = np.argmax(x @ centres.T - 0.5 * (centres**2).sum(1), axis=1)
    square = ((x - centres[near]) ** 2).mean(1)
    count = np.bincount(near, minlength=len(centres))
    spread = np.sqrt(np.bincount(near, weights=square, minlength=len(centres)) / np.maximum(count, 1))
    usual = np.sqrt(square.mean()) or 1.0
    return centres, np.where((count > 1) & (spread > 1e-6 * usual), spread, usual).astype(np.float32)


def fit_quantiser(x: np.ndarray, rounds: int = 6, seed: int = 1) -> Quantiser:
    """Codebooks by alternating codes and, for each centre, the least anisotropic loss with the rest fixed."""
    dim = x.shape[1]
    subs = -(-dim // SUB)
    t = SCORE_SHARE**2
    eta = max(1.0, (dim - 1) * t / (1 - t))
    rng = np.random.default_rng(seed)
    x = np.pad(x, ((0, 0), (0, subs * SUB - dim))).astype(np.float32)
    q = Quantiser(*coarse_centres(x, rng), np.zeros((subs, CENTRES, SUB), np.float32), eta)
    _, parts, units = q.parts(x)
    for s in range(subs):
        q.books[s] = parts[rng.choice(len(x), CENTRES, replace=len(x) < CENTRES), s]
    for turn in range(rounds):
        code, _ = q.code(parts, units, rounds=0 if turn < 2 else 1)
        along = ((parts - q.books[np.arange(subs), code]) * units).sum(-1)
        total = along.sum(1)
        for s in range(subs):
            rest = total - along[:, s] + (parts[:, s] * units[:, s]).sum(-1)
            for c in range(CENTRES):
                own = code[:, s] == c
                if own.any():
                    u = units[own, s]
                    left = own.sum() * np.eye(SUB) + (eta - 1) * u.T @ u
                    right = parts[own, s].sum(0) + (eta - 1) * (u * rest[own, None]).sum(0)
                    q.books[s, c] = np.linalg.solve(left, right)
            along[:, s] = ((parts[:, s] - q.books[s][code[:, s]]) * units[:, s]).sum(-1)
            total = along.sum(1)
    return q


def usable(vector: Column) -> Column:
    """True for a vector that isn't null, empty or zero and has finite components only."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pd.Series, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(len(column), -1).astype(np.float64)


def _flat(df: DataFrame, dim: int, kind: str) -> DataFrame:
    """Distinct (vec_id, v) with v as bytes of numpy's ``kind``, and a hash of v that tells rows with one vec_id apart."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"vec_id": frame["vec_id"], "v": [(np.asarray(v, kind) + 0).tobytes() for v in frame["v"]]})  # + 0: no negative zeros

    flat = df.filter(F.size("v") == dim).mapInPandas(run, "vec_id long, v binary")
    return flat.dropDuplicates(["vec_id", "v"]).withColumn("mark", F.xxhash64("v"))


def best_by_code(codes: DataFrame, asked: DataFrame, quantiser, most: int, kind: str) -> DataFrame:
    """(query_id, query_mark, vec_id, mark): for each query the ``most`` best by code of a block, ties to the smaller vec_id.

    Both tables have block and part. A task takes its blocks one after the
    other: the block's codes first, then its queries as they stream by.
    """
    columns = ["block", "part", "is_query", "vec_id", "mark", "near", "body"]
    rows = codes.withColumn("is_query", F.lit(False)).select(columns)
    rows = rows.union(asked.select("block", "part", F.lit(True), "vec_id", "mark", F.lit(0), F.col("v")))
    rows = rows.repartition("block", "part").sortWithinPartitions("block", "part", "is_query", "vec_id")

    def scan(ids, marks, near, code, spread, q_ids, q_marks, q) -> pd.DataFrame:
        tables, coarse = quantiser.value.tables(q), quantiser.value.pad(q) @ quantiser.value.coarse.T
        out = []
        for i, table in enumerate(tables):
            found = np.zeros(len(ids), np.float32)
            for position, bytes_ in enumerate(code):
                found += table[position][bytes_]
            found = coarse[i][near] + spread * found
            found[ids == q_ids[i]] = -np.inf
            best = np.argpartition(-found, most)[:most] if len(found) > most else np.arange(len(found))
            if len(found) > most:  # of equal ones at the edge those that come first, which have the smaller vec_id
                edge = found[best].min()
                above = np.flatnonzero(found > edge)
                best = np.concatenate([above, np.flatnonzero(found == edge)[: most - len(above)]])
            best = best[ids[best] != q_ids[i]]
            out.append(pd.DataFrame({"query_id": q_ids[i], "query_mark": q_marks[i], "vec_id": ids[best], "mark": marks[best], "rough": found[best]}))
        return pd.concat(out)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held, block = None, [], None
        for frame in frames:
            group = (frame["block"].to_numpy().astype(np.int64) << 31) + frame["part"].to_numpy()
            edges = np.flatnonzero(np.diff(2 * group + frame["is_query"].to_numpy(), prepend=-1) != 0)
            for lo, hi in zip(edges, [*edges[1:], len(frame)]):
                own, key = frame.iloc[lo:hi], group[lo]
                if key != at:
                    at, held, block = key, [], None
                if not own["is_query"].iloc[0]:
                    held.append((own["vec_id"].to_numpy(), own["mark"].to_numpy(), own["near"].to_numpy(), np.frombuffer(b"".join(own["body"]), np.uint8).reshape(len(own), -1)))
                    continue
                if not held:
                    continue
                if block is None:
                    ids, marks, near = (np.concatenate([h[k] for h in held]) for k in range(3))
                    block = ids, marks, near, np.ascontiguousarray(np.concatenate([h[3] for h in held]).T), quantiser.value.spread[near]
                    held = [held[0]]
                for a in range(0, len(own), 64):
                    some = own.iloc[a : a + 64]
                    yield scan(*block, some["vec_id"].to_numpy(), some["mark"].to_numpy(), _matrix(some["body"], kind))

    return rows.mapInPandas(run, "query_id long, query_mark long, vec_id long, mark long, rough float")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, sample: int = SAMPLE, oversample: int = OVERSAMPLE) -> DataFrame:
    """query_id, rank, vec_id and score of the k vectors with the largest inner product.

    Both tables have vec_id and embedding. A query's own vec_id is no candidate.
    Ties go to the smaller vec_id. Vectors that ``usable`` refuses, or whose
    length isn't the commonest one (the smaller, if two are), take no part; rows
    without vec_id neither. Rows that are wholly equal, as far as vec_id and
    embedding go, count once, among the vectors and among the queries; rows
    that repeat a vec_id with another vector are candidates, and queries, of
    their own. Of equal vectors the k + 1 with the smallest vec_id are searched,
    since no answer can hold more; that also keeps a vector that a third of all
    rows share from filling the candidates. An empty table gives an empty table.
    Every vector is scanned by its code; ``oversample`` * k of them are scored exactly.
    """
    spark = vectors.sparkSession
    # components travel as the four bytes that they have in both tables, else as eight
    kind = "<f4" if all(df.schema["embedding"].dataType.elementType.typeName() == "float" for df in (vectors, queries)) else "<f8"
    clean = lambda df: df.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if kind == "<f4" else "array<double>").alias("v")
    )
    data, asked = clean(vectors), clean(queries)
    lengths = data.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, rows = lengths[0]["dim"], lengths[0]["count"]

    data, asked = _flat(data, dim, kind), materialize(_flat(asked, dim, kind))
    alike = Window.partitionBy("v").orderBy("vec_id")
    data = materialize(data.withColumn("_k", F.row_number().over(alike)).filter(F.col("_k") <= k + 1).drop("_k"))
    known = _matrix(data.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(sample).toPandas().sort_values(["vec_id"])["v"], kind)
    quantiser = spark.sparkContext.broadcast(fit_quantiser(known))

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            near, code = quantiser.value.encode(_matrix(frame["v"], kind)) if len(frame) else ([], np.empty((0, 0), np.uint8))
            yield pd.DataFrame({"vec_id": frame["vec_id"], "mark": frame["mark"], "near": near, "body": [c.tobytes() for c in packed(code).T]})

    n_blocks, n_parts = -(-rows // BLOCK), -(-max(1, asked.count()) // QUERY_BLOCK)
    codes = materialize(data.mapInPandas(encode, "vec_id long, mark long, near int, body binary"))
    codes = codes.withColumn("block", F.pmod(F.xxhash64("vec_id", "mark"), F.lit(n_blocks)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))))
    dealt = asked.withColumn("part", F.pmod(F.xxhash64("vec_id", "mark"), F.lit(n_parts)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    most = oversample * k
    rough = Window.partitionBy("query_id", "query_mark").orderBy(F.desc("rough"), "vec_id", "mark")
    chosen = best_by_code(codes, dealt, quantiser, most, kind).withColumn("_k", F.row_number().over(rough)).filter(F.col("_k") <= most)
    q = asked.select(F.col("vec_id").alias("query_id"), F.col("mark").alias("query_mark"), F.col("v").alias("q"))
    met = chosen.select("query_id", "query_mark", "vec_id", "mark").join(data, ["vec_id", "mark"]).join(q, ["query_id", "query_mark"])

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield frame[["query_id", "query_mark", "vec_id"]].assign(score=np.einsum("ij,ij->i", _matrix(frame["v"], kind), _matrix(frame["q"], kind)))

    scored = met.mapInPandas(score, "query_id long, query_mark long, vec_id long, score double")
    best = Window.partitionBy("query_id", "query_mark").orderBy(F.desc("score"), "vec_id")
    ranked = scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
