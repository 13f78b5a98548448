"""Exact top-k inner products over a bit-sliced index."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import finite_vector, give_back, partitions, usual_length, written

#: Components below this can be shifted to unsigned ones, and scores below twice that are longs.
LARGEST_COMPONENT = 1 << 62


def build_slices(values: np.ndarray) -> tuple[int, int, np.ndarray]:
    """(offset, bits, slices): bit ``b`` of ``values + offset`` as a bitmap over the rows.

    ``slices`` has shape (dimensions, bits, words of 64 rows).
    """
    n, dims = values.shape
    offset = int(-values.min())
    shifted = (values + offset).astype(np.uint64)
    bits = max(1, int(shifted.max()).bit_length())
    words = -(-n // 64)
    slices = np.zeros((dims, bits, words * 8), np.uint8)
    for b in range(bits):
        packed = np.packbits(((shifted >> np.uint64(b)) & np.uint64(1)).astype(np.uint8).T, axis=1, bitorder="little")
        slices[:, b, : packed.shape[1]] = packed
    return offset, bits, slices.view("<u8")


def add_slices(slices: np.ndarray, query: np.ndarray, offset: int) -> tuple[list[np.ndarray], int]:
    """Bitmaps of the bits of every row's inner product with ``query``, lowest first, and what to add to it.

    A bit of a component times a bit of the query's component is the slice itself at
    the summed weight; for a negative component its complement is added instead, so
    all terms are positive. Slices of one weight are added three at a time with
    carry-save adders (sum and carry are bitmap operations).
    """
    dims, bits, words = slices.shape
    size, negative = np.abs(query), query < 0
    full = (1 << bits) - 1
    constant = sum(-q * offset for q in query[~negative].tolist()) + sum(q * (offset - full) for q in size[negative].tolist())
    flip = np.where(negative, ~np.uint64(0), np.uint64(0))
    top = int(size.max()).bit_length() if len(size) else 0
    members = [np.flatnonzero((size >> j) & 1) for j in range(top)]
    out, carried, weight = [], [], 0
    while weight < top + bits - 1 or carried:
        rows = [slices[m, weight - j] ^ flip[m, None] for j, m in enumerate(members) if 0 <= weight - j < bits and len(m)]
        stack = np.concatenate(rows + carried) if rows or carried else np.zeros((0, words), np.uint64)
        carried = []
        while len(stack) > 1:
            if len(stack) == 2:
                a, b = stack
                stack = (a ^ b)[None]
                carried.append((a & b)[None])
                break
            third = len(stack) // 3
            a, b, c = stack[:third], stack[third : 2 * third], stack[2 * third : 3 * third]
            half = a ^ b
            carried.append((a & b) | (c & half))
            stack = np.concatenate([half ^ c, stack[3 * third :]])
        out.append(stack[0] if len(stack) else np.zeros(words, np.uint64))
        weight += 1
    return out, constant


def top_rows(sums: list[np.ndarray], candidates: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` largest sums among ``candidates``, ties to the lower position.

    From the most significant slice downward: rows that have the bit and are no more
    than still wanted are in; if they are more, only they stay candidates. Rows that
    agree in all slices are the boundary, of which the first are taken.
    """
    sure, maybe = np.zeros_like(candidates), candidates.copy()
    have = 0
    for bitmap in reversed(sums):
        ones = maybe & bitmap
        n = int(np.bitwise_count(ones).sum())
        if have + n > k:
            maybe = ones
        else:
            sure, maybe, have = sure | ones, maybe & ~bitmap, have + n
            if have == k:
                break
    positions = lambda bitmap: np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))
    return np.concatenate([positions(sure), positions(maybe)[: k - have]])


def values_at(sums: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
    """The sums of single rows, read from the slices, modulo 2^64."""
    word, bit = rows // 64, (rows % 64).astype(np.uint64)
    return sum((((s[word] >> bit) & np.uint64(1)).astype(np.int64) << i for i, s in enumerate(sums[:64])), np.zeros(len(rows), np.int64))


def exact_value(sums: list[np.ndarray], row: int) -> int:
    """The sum of a row, however many bits it has."""
    return sum((int(s[row // 64]) >> row % 64 & 1) << i for i, s in enumerate(sums))


def exact_top_k(vectors: DataFrame, k: int = 20, query_step: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = 16_384, query_rows: int = 256) -> DataFrame:
    """The ``k`` largest integer inner products of every row whose id is divisible by ``query_step``.

    Components are quantised to ``floor(scale * x)``. Rows are dealt out by hash into
    blocks of about ``block_rows``, each kept as bit slices (written once); the
    stated queries go to every block in blocks of ``query_rows``, and each meeting
    sends back ``k`` rows a query. All is exact. Only where there are fewer blocks than
    partitions are blocks copied, so that all tasks have work.

    Result: query_id, rank (from 1), vec_id, score; ties to the smaller vec_id; all
    candidates where there are fewer than ``k``. Vectors that are null, empty, of
    another length than the most frequent one (the longer of equally frequent) or hold
    null or non-finite components take no part, nor do null ids. Components so large
    that an inner product could reach 2^59 raise a ValueError, for scores are longs.
    Rows that repeat an id are candidates each, for all but that id; a repeated query id is
    asked once. Empty table: no rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.filter(F.col("vec_id").isNotNull() & finite_vector("v", nonzero=False))
    n_rows, dims = usual_length(rows, "v")
    if not n_rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rows = rows.filter(F.size("v") == dims)
    largest = rows.agg(F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))).first()[0] * scale + 1
    if not largest < LARGEST_COMPONENT:
        raise ValueError(f"a component of {largest / scale:g} is too large")
    rows = rows.select("vec_id", F.transform("v", lambda x: F.floor(x * scale)).alias("v"))
    n_blocks = -(-n_rows // block_rows)
    n_asked = rows.filter(F.col("vec_id") % query_step == 0).count()
    n_query_blocks = max(1, -(-n_asked // query_rows))

    def build(key, pdf):
        import pandas as pd

        pdf = pdf.sort_values("vec_id")
        offset, bits, slices = build_slices(np.stack(pdf["v"].to_numpy()).astype(np.int64))
        return pd.DataFrame([(key[0], pdf["vec_id"].to_numpy().astype("<i8").tobytes(), offset, bits, slices.tobytes())], columns=["block", "ids", "lift", "bits", "slices"])

    placed = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).cast("int"))
    index = written(placed.groupBy("block").applyInPandas(build, "block int, ids binary, lift long, bits int, slices binary"), "bit-slices")

    def gather(key, pdf):
        import pandas as pd

        return pd.DataFrame([(key[0], pdf["vec_id"].to_numpy().astype("<i8").tobytes(), np.stack(pdf["v"].to_numpy()).astype("<i8").tobytes())], columns=["query_block", "query_ids", "queries"])

    asked = rows.filter(F.col("vec_id") % query_step == 0).dropDuplicates(["vec_id"])
    asked = asked.withColumn("query_block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(n_query_blocks)).cast("int"))
    asked = asked.groupBy("query_block").applyInPandas(gather, "query_block int, query_ids binary, queries binary")
    copies = min(n_query_blocks, -(-4 * partitions(spark) // n_blocks))
    width = n_blocks * copies
    index = index.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).repartition(width, "block", "copy")
    to_blocks = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).withColumn("copy", F.col("query_block") % copies).repartition(width, "block", "copy")

    def search(frames):
        import pandas as pd

        for pdf in frames:
            out = []
            for r in pdf.itertuples():
                ids, query_ids = np.frombuffer(r.ids, "<i8"), np.frombuffer(r.query_ids, "<i8")
                slices = np.frombuffer(r.slices, "<u8").reshape(dims, r.bits, -1)
                everything = np.zeros(slices.shape[2] * 8, np.uint8)
                packed = np.packbits(np.ones(len(ids), np.uint8), bitorder="little")
                everything[: len(packed)] = packed
                everything = everything.view("<u8")
                for query_id, query in zip(query_ids.tolist(), np.frombuffer(r.queries, "<i8").reshape(len(query_ids), -1)):
                    candidates = everything.copy()
                    for own in range(*np.searchsorted(ids, [query_id, query_id + 1])):
                        candidates[own // 64] &= ~(np.uint64(1) << np.uint64(own % 64))
                    sums, constant = add_slices(slices, query, int(r.lift))
                    found = top_rows(sums, candidates, k)
                    wrapped = np.int64((constant + (1 << 63)) % (1 << 64) - (1 << 63))
                    if (len(sums) > 62 or abs(constant) >> 62) and any(not -(1 << 63) <= exact_value(sums, f) + constant < 1 << 63 for f in found.tolist()):
                        raise ValueError(f"a score of query {query_id} does not fit a long")
                    out.append(pd.DataFrame({"query_id": query_id, "vec_id": ids[found], "score": values_at(sums, found) + wrapped}))
            if out:
                yield pd.concat(out)
        give_back()

    pairs = to_blocks.join(index.hint("shuffle_hash"), ["block", "copy"])
    found = pairs.select("ids", "lift", "bits", "slices", "query_ids", "queries").mapInPandas(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
