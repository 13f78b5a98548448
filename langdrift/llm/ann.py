"""Approximate nearest neighbours by adaptive dimension scan over probed lists."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import finite_vector, give_back, partitions, usual_length, written


@dataclass
class ListIndex:
    """What is fitted on the bounded sample: rotation, list centres, lists to probe, and the sample list by list for first bounds."""

    rotation: np.ndarray
    centres: np.ndarray
    probes: int
    sample: np.ndarray
    sample_ids: np.ndarray
    sample_starts: np.ndarray


def listed_sample(rotation, centres, probes, ids, sample, own) -> ListIndex:
    order = np.argsort(own, kind="stable")
    return ListIndex(rotation, centres, probes, sample[order], ids[order], np.searchsorted(own[order], np.arange(len(centres) + 1)))


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(1)[None] - 2 * points @ centres.T, axis=1)


def fit_lists(ids: np.ndarray, sample: np.ndarray, n_rows: int, k: int, recall: float, seed: int) -> ListIndex:
    """k-means lists, a random rotation and the number of lists to probe.

    The probes are calibrated on the sample: the least share of lists that holds
    ``recall`` of the true neighbours of 256 sample rows within the sample, and then
    a tenth of the lists more.
    """
    rng = np.random.default_rng(seed)
    n, dims = sample.shape
    rotation = np.linalg.qr(rng.standard_normal((dims, dims)))[0].astype(np.float32)
    n_lists = int(min(4096, max(1, n // 16), max(1, np.sqrt(n_rows))))
    centres = sample[rng.choice(n, n_lists, replace=False)].copy()
    for _ in range(8):
        own = nearest(sample, centres)
        size = np.bincount(own, minlength=n_lists)
        total = np.zeros_like(centres)
        np.add.at(total, own, sample)
        centres[size > 0] = total[size > 0] / size[size > 0, None]
    own, asked = nearest(sample, centres), rng.choice(n, min(n, 256), replace=False)
    far = ((sample[asked] ** 2).sum(1)[:, None] + (sample**2).sum(1)[None] - 2 * sample[asked] @ sample.T).copy()
    far[np.arange(len(asked)), asked] = np.inf
    k = min(k, n - 1)
    if k < 1 or n_lists == 1:
        return listed_sample(rotation, centres, n_lists, ids, sample, own)
    true = np.argpartition(far, k - 1, axis=1)[:, :k]
    order = np.argsort(np.argsort((centres**2).sum(1)[None] - 2 * sample[asked] @ centres.T, axis=1), axis=1)
    ranks = np.take_along_axis(order, own[true], axis=1).ravel()
    need = int(np.quantile(ranks, recall, method="higher")) + 1
    return listed_sample(rotation, centres, min(n_lists, need + -(-n_lists // 10)), ids, sample, own)


def first_bound(fit: ListIndex, probed: np.ndarray, query_id: int, query: np.ndarray, k: int) -> float:
    """Squared distance within which ``k`` rows of the probed lists lie; infinite where too few are known.

    Measured in double precision on the sample rows of the nearest of the probed lists,
    as many lists as give ``8 * k`` rows. They are candidates of the scan, so the bound
    never falls below what it can find.
    """
    rows, have = [], 0
    for at in probed:
        low, high = fit.sample_starts[at], fit.sample_starts[at + 1]
        rows.append(np.arange(low, high)[fit.sample_ids[low:high] != query_id])
        have += len(rows[-1])
        if have >= 8 * k:
            break
    if have < k:
        return np.inf
    far = ((fit.sample[np.concatenate(rows)].astype(np.float64) - query) ** 2).sum(1)
    return float(np.partition(far, k - 1)[k - 1])


def adaptive_scan(query: np.ndarray, rotated_query: np.ndarray, exact: np.ndarray, blocks: list[np.ndarray], ids: np.ndarray, k: int, bound: float, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    """(ids, squared distances) of the candidates that may be among the ``k`` nearest of a query.

    ``blocks`` are column blocks of the rotated vectors. After ``d`` of ``D`` rotated
    dimensions, ``D / d`` times the partial distance estimates the whole; a candidate
    is abandoned when even ``1 + epsilon / sqrt(d)`` times the bound doesn't reach it.
    The first candidates are measured whole to get a bound of this list.
    """
    dims, n = exact.shape[1], len(ids)
    if n == 0:
        return ids, np.empty(0)
    first = min(n, 8 * k)
    if first >= k:
        start = ((exact[:first].astype(np.float64) - query) ** 2).sum(1)
        bound = min(bound, float(np.partition(start, k - 1)[k - 1]))
    alive, partial, seen = np.arange(n), np.zeros(n, np.float32), 0
    for at, block in enumerate(blocks):
        part = block if len(alive) == n else block[alive]
        step = part - rotated_query[seen : seen + block.shape[1]]
        partial = partial + np.einsum("ij,ij->i", step, step)
        seen += block.shape[1]
        if at + 1 < len(blocks):
            keep = partial * (dims / seen) <= bound * (1 + epsilon / np.sqrt(seen)) ** 2 + 1e-6
            alive, partial = alive[keep], partial[keep]
            if not len(alive):
                return ids[:0], np.empty(0)
    alive = alive[partial <= bound * (1 + 1e-4) + 1e-5]
    return ids[alive], ((exact[alive].astype(np.float64) - query) ** 2).sum(1)


def best(ids: np.ndarray, distances: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, distances))[:k]
    return ids[order], distances[order]


def nearest_neighbours(
    vectors: DataFrame, k: int = 10, query_step: int = 100, id_col: str = "vec_id", vector_col: str = "embedding", sample_rows: int = 20_000, recall: float = 0.97, block_rows: int = 8192, column_block: int = 16, epsilon: float = 2.1, seed: int = 7
) -> DataFrame:
    """The ``k`` nearest rows of every row whose id is divisible by ``query_step``.

    Lists, rotation and probes are fitted on the ``sample_rows`` rows with the least
    hash of their id (the documented bound of what reaches the driver); every row is
    indexed. Lists are cut into blocks of about ``block_rows`` rows, so that a list
    with a third of all rows is many tasks' work; a query goes to each block of its
    probed lists, is scanned there by ``adaptive_scan``, and brings back at most
    ``k`` rows a block. The first bound comes from sample rows of the probed lists;
    queries that are left with fewer than ``k`` rows all the same (a candidate may be
    abandoned by chance) are compared with every row of their lists.

    Result: query_id, rank (from 1), vec_id, score (Euclidean distance on the
    original vectors in double precision); ties to the smaller vec_id. A query has
    all candidates where there are fewer than ``k``. Vectors that are null, zero,
    empty, of another length than the most frequent one (the longer of equally
    frequent), or hold null or non-finite components take no part, nor do null ids. Rows that repeat an id are candidates
    each, for all but that id; a repeated query id is asked once. Empty table:
    no rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.filter(F.col("vec_id").isNotNull() & finite_vector("v", nonzero=True))
    n_rows, dims = usual_length(rows, "v")
    result = "query_id long, rank int, vec_id long, score double"
    if not n_rows:
        return spark.createDataFrame([], result)
    rows = rows.filter(F.size("v") == dims)
    sampled = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).toPandas()
    sample = np.stack(sampled["v"].to_numpy()).astype(np.float32)
    fitted = fit_lists(sampled["vec_id"].to_numpy(), sample, n_rows, k, recall, seed)
    shared = spark.sparkContext.broadcast(fitted)

    def assign(frames):
        for pdf in frames:
            if len(pdf):
                pdf["list"] = nearest(np.stack(pdf["v"].to_numpy()).astype(np.float32), shared.value.centres)
                yield pdf
        give_back()

    listed = written(rows.mapInPandas(assign, "vec_id long, v array<double>, list int"), "ann-lists")
    sizes = np.zeros(len(fitted.centres), np.int64)
    for r in listed.groupBy("list").count().collect():  # at most 4096 lists
        sizes[r["list"]] = r["count"]
    n_rows, n_blocks = int(sizes.sum()), -(-sizes // block_rows)
    probes = fitted.probes

    def probe(frames):
        fit = shared.value
        for pdf in frames:
            if not len(pdf):
                continue
            q = np.stack(pdf["v"].to_numpy()).astype(np.float32)
            order = np.argsort((fit.centres**2).sum(1)[None] - 2 * q @ fit.centres.T, axis=1, kind="stable")
            out = []
            for i, (vec, query, own) in enumerate(zip(pdf["vec_id"].tolist(), pdf["v"].tolist(), pdf["own"].tolist())):
                enough = int(np.searchsorted(np.cumsum(sizes[order[i]]), k + own)) + 1
                probed = order[i][: max(probes, enough)]
                bound = first_bound(fit, probed, vec, np.array(query), k) * (1 + 1e-4) + 1e-5
                out += [(vec, query, lst, b, bound) for lst in probed.tolist() for b in range(n_blocks[lst])]
            import pandas as pd

            yield pd.DataFrame(out, columns=["query_id", "q", "list", "block", "bound"])

    queries = listed.filter(F.col("vec_id") % query_step == 0).groupBy("vec_id").agg(F.first("v").alias("v"), F.count(F.lit(1)).alias("own"))
    queries = written(queries.repartition(partitions(spark)), "ann-queries")
    blocks = F.element_at(F.array(*[F.lit(int(max(1, b))) for b in n_blocks]), F.col("list") + 1)
    stored = listed.withColumn("block", F.pmod(F.xxhash64("vec_id"), blocks).cast("int"))

    def scan(key, store, ask):
        import pandas as pd

        out = []
        if len(store) and len(ask):
            exact, ids = np.stack(store["v"].to_numpy()), store["vec_id"].to_numpy()
            turned = exact.astype(np.float32) @ shared.value.rotation
            columns = [np.ascontiguousarray(turned[:, a : a + column_block]) for a in range(0, turned.shape[1], column_block)]
            for query_id, q, bound in zip(ask["query_id"].tolist(), ask["q"], ask["bound"].tolist()):
                # one more than k, for the query's own row may be among them
                found = adaptive_scan(q, q.astype(np.float32) @ shared.value.rotation, exact, columns, ids, k + 1 + int((ids == query_id).sum()), bound, epsilon)
                other = found[0] != query_id
                got, far = best(found[0][other], found[1][other], k)
                out += [(query_id, v, s) for v, s in zip(got.tolist(), np.sqrt(far).tolist())]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    def scan_all(key, store, ask):
        import pandas as pd

        out = []
        if len(store) and len(ask):
            exact, ids = np.stack(store["v"].to_numpy()).astype(np.float64), store["vec_id"].to_numpy()
            for query_id, q in zip(ask["query_id"].tolist(), ask["q"]):
                other = ids != query_id
                got, far = best(ids[other], ((exact[other] - q) ** 2).sum(1), k)
                out += [(query_id, v, s) for v, s in zip(got.tolist(), np.sqrt(far).tolist())]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    def ranked(queries, stored, how):
        asked = queries.mapInPandas(probe, "query_id long, q array<double>, list int, block int, bound double")
        found = stored.groupBy("list", "block").cogroup(asked.groupBy("list", "block")).applyInPandas(how, "query_id long, vec_id long, score double")
        order = Window.partitionBy("query_id").orderBy("score", "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    found = written(ranked(queries, stored, scan), "ann-found")
    have = found.groupBy(F.col("query_id").alias("vec_id")).agg(F.count(F.lit(1)).alias("have"))
    short = queries.join(have, "vec_id", "left").filter(F.coalesce("have", F.lit(0)) < F.least(F.lit(k), n_rows - F.col("own"))).drop("have")
    short = written(short, "ann-short")
    if short.isEmpty():
        return found
    whole = ranked(short.repartition(partitions(spark)), stored, scan_all)
    return found.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(whole)
