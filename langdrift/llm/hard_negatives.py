"""Hard negatives by exact scores: residue matrices multiplied in float32, joined by Chinese remaindering."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import finite_vector, give_back, partitions, usual_length, written

#: Integers up to this are exact in float32, and so are sums that never exceed it.
EXACT_FLOAT32 = 1 << 24
#: Columns multiplied at once; a product of residues is then small enough for primes up to 127.
COLUMNS = 4096
LONG = 1 << 63


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def residue_primes(dims: int, bound: float) -> list[int]:
    """Odd primes, the largest first, whose product exceeds ``2 * bound + 1``.

    Each is so small that ``dims`` products (``COLUMNS``, if fewer) of residues between
    -(p - 1) / 2 and (p - 1) / 2 sum to at most 2^24.
    """
    half = int((EXACT_FLOAT32 / max(1, min(dims, COLUMNS))) ** 0.5)
    found, product, p = [], 1, min(2 * half + 1, 2047)
    while product <= 2 * bound + 1:
        if p < 3:
            raise ValueError(f"no primes for {dims} columns and scores up to {bound:g}")
        if is_prime(p):
            found.append(p)
            product *= p
        p -= 2
    return found


def centred(values: np.ndarray, p: int) -> np.ndarray:
    """Residues between -(p - 1) / 2 and (p - 1) / 2."""
    r = values % p
    return r - p * (r > p // 2)


def residue_products(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """``a @ b.T`` modulo ``p``, as centred residues; every sum of a float32 product is exact."""
    total = np.zeros((len(a), len(b)), np.int64)
    for at in range(0, a.shape[1], COLUMNS):
        part = centred(a[:, at : at + COLUMNS], p).astype(np.float32) @ centred(b[:, at : at + COLUMNS], p).astype(np.float32).T
        total += part.astype(np.int64)
    return centred(total, p)


def signed_scores(a: np.ndarray, b: np.ndarray, primes: list[int]) -> np.ndarray:
    """The exact inner products of the rows of two integer matrices, from their residues modulo ``primes``.

    Mixed-radix digits, each between -(p - 1) / 2 and (p - 1) / 2, so the sum is the signed
    score itself and only has to fit a long where it is added up; it is right modulo 2^64.
    """
    digits: list[np.ndarray] = []
    total, radix = np.zeros((len(a), len(b)), np.int64), 1
    for i, p in enumerate(primes):
        digit = residue_products(a, b, p)
        place = 1
        for q, d in zip(primes, digits):
            digit = digit - d * (place % p)
            place = place * q % p
        digit = centred(digit * pow(radix, -1, p), p)
        digits.append(digit)
        signed = (radix + LONG) % (2 * LONG) - LONG
        total += digit * np.int64(signed)
        radix *= p
    return total


def refuse_beyond_longs(a: np.ndarray, b: np.ndarray, asked: np.ndarray) -> None:
    """A ValueError if one of the ``asked`` inner products (a mask) is no long."""
    if (np.abs(a.astype(np.float64) @ b.T.astype(np.float64))[asked] >= LONG * (1 - 1e-9)).any():
        raise ValueError("a score does not fit a long")


def first_by_score(scores: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Of the positions ``at`` (ascending) those of the ``k`` highest scores, ties to the lower position."""
    own = scores[at]
    if len(at) > k:
        keep = own >= np.partition(own, len(own) - k)[len(own) - k]
        at, own = at[keep], own[keep]
    return at[np.argsort(-own, kind="stable")[:k]]


def window_bounds(positive: int, least: int, most: int) -> tuple[int, int]:
    """Least and greatest score s with ``least * positive <= 100 * s <= most * positive``."""
    return -(-least * positive // 100), most * positive // 100


BLOCK = "block int, ids binary, labels binary, matrix binary"


def mine_hard_negatives(
    vectors: DataFrame, anchor_step: int = 100, n_positives: int = 5, n_negatives: int = 5, least: int = 80, most: int = 100, scale: float = 256.0,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", block_rows: int = 16_384, anchor_rows: int = 128,
) -> DataFrame:
    """For each anchor and each of its positives the best-scored rows of other labels inside the positive's window.

    Components become ``floor(scale * x)``; a score is the exact integer inner product.
    Anchors are rows whose id is divisible by ``anchor_step``; positives their first
    ``n_positives`` other rows of the same label, negatives the first ``n_negatives`` rows of
    other labels whose score is between ``least`` and ``most`` per cent of the positive's.

    All rows are dealt into blocks of about ``block_rows``, written once; anchors go to every
    block in blocks of ``anchor_rows``, and each meeting multiplies residue matrices and sends
    back a few rows an anchor. Positives are found in a first pass, negatives in a second.
    Where there are fewer blocks than tasks, blocks are copied.

    Result: anchor_id, positive_id, rank (from 1), negative_id, positive_score,
    negative_score; ties to the smaller id; fewer rows where there are fewer. Rows take no part
    with a null id or label, a vector that is null, empty, of another length than the most
    frequent one or holds null or non-finite components. Candidates are rows of other ids than
    the anchor's; rows that repeat an id are candidates each, and a repeated anchor id is asked
    once, with its least label and vector. A component beyond 2^62 or a score beyond a long
    raises an error. Empty table: no rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite_vector("v", nonzero=False))
    n_rows, dims = usual_length(rows, "v")
    if not n_rows:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    rows = rows.filter(F.size("v") == dims)
    is_anchor = F.col("vec_id") % anchor_step == 0
    scaled = F.transform("v", lambda x: F.floor(x * scale).cast("double"))
    facts = rows.select("vec_id", F.array_max(F.transform(scaled, F.abs)).alias("m"), F.aggregate(scaled, F.lit(0.0), lambda s, x: s + x * x).alias("s"))
    facts = facts.agg(F.max("m").alias("largest"), F.max("s").alias("square"), F.max(F.when(is_anchor, F.col("s"))).alias("anchor_square"), F.count_distinct(F.when(is_anchor, F.col("vec_id"))).alias("n_anchors")).first()
    if not facts["largest"] < 1 << 62:
        raise ValueError(f"a component of {facts['largest']:g} is too large")
    bound = ((facts["anchor_square"] or 0.0) * facts["square"]) ** 0.5 * (1 + 1e-9) + 1
    primes, check = residue_primes(dims, bound), bound >= LONG
    width = next(w for w in ("<i2", "<i4", "<i8") if w == "<i8" or facts["largest"] < 1 << (8 * int(w[2]) - 1))
    n_blocks, n_anchor_blocks = -(-n_rows // block_rows), max(1, -(-facts["n_anchors"] // anchor_rows))
    rows = rows.select("vec_id", "label", F.transform("v", lambda x: F.floor(x * scale)).alias("v"))

    def gather(key, pdf):
        import pandas as pd

        pdf = pdf.sort_values("vec_id", kind="stable")
        matrix = np.stack(pdf["v"].to_numpy()).astype(width)
        return pd.DataFrame([(key[0], *(pdf[c].to_numpy().astype("<i8").tobytes() for c in ("vec_id", "label")), matrix.tobytes())], columns=[c.split()[0] for c in BLOCK.split(", ")])

    # by place in the input, so that rows which repeat an id spread too
    placed = rows.withColumn("block", (F.monotonically_increasing_id() % n_blocks).cast("int"))
    index = written(placed.groupBy("block").applyInPandas(gather, BLOCK), "negatives-index")
    asked = rows.filter(is_anchor).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("own")).select("vec_id", "own.*")
    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n_anchor_blocks)).cast("int")).groupBy("block").applyInPandas(gather, BLOCK)
    asked = written(asked.select(F.col("block").alias("anchors"), F.col("ids").alias("anchor_ids"), F.col("labels").alias("anchor_labels"), F.col("matrix").alias("anchor_matrix")), "negatives-anchors")
    copies = min(n_anchor_blocks, -(-4 * partitions(spark) // n_blocks))
    parts = n_blocks * copies

    def meet(anchors: DataFrame, search, schema: str) -> DataFrame:
        """``search`` for every block of anchors in every block of rows."""
        mine = index.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).repartition(parts, "block", "copy")
        theirs = anchors.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).withColumn("copy", F.col("anchors") % copies).repartition(parts, "block", "copy")

        def run(frames):
            import pandas as pd

            for pdf in frames:
                out = []
                for r in pdf.itertuples():
                    ids, labels, own, own_labels = (np.frombuffer(x, "<i8") for x in (r.ids, r.labels, r.anchor_ids, r.anchor_labels))
                    a, b = (np.frombuffer(x, width).reshape(n, dims).astype(np.int64) for x, n in ((r.anchor_matrix, len(own)), (r.matrix, len(ids))))
                    if check:
                        refuse_beyond_longs(a, b, own[:, None] != ids)
                    scores = signed_scores(a, b, primes)
                    for i in range(len(own)):
                        out += search(r, int(own[i]), scores[i], labels == own_labels[i], ids)
                if out:
                    yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])
            give_back()

        pairs = theirs.join(mine.hint("shuffle_hash"), ["block", "copy"])
        return pairs.drop("block", "copy", "anchors").mapInPandas(run, schema)

    def positives_in(r, anchor, scores, same, ids):
        return [(anchor, int(ids[j]), int(scores[j])) for j in first_by_score(scores, np.flatnonzero(same & (ids != anchor)), n_positives)]

    def negatives_in(r, anchor, scores, same, ids):
        out, wanted = [], [(p["positive_id"], p["positive_score"], p["place"]) for p in r.positives if p["anchor_id"] == anchor]
        if not wanted:
            return out
        windows = [window_bounds(int(s), least, most) for _, s, _ in wanted]
        maybe = np.flatnonzero(~same & (ids != anchor) & (scores >= min(w[0] for w in windows)) & (scores <= max(w[1] for w in windows)))
        maybe = maybe[np.argsort(-scores[maybe], kind="stable")]
        falling = -scores[maybe]
        for (positive, score, place), (low, high) in zip(wanted, windows):
            begin, end = np.searchsorted(falling, -high, "left"), np.searchsorted(falling, -low, "right")
            out += [(anchor, int(positive), int(score), int(place), int(ids[j]), int(scores[j])) for j in maybe[begin : min(end, begin + n_negatives)]]
        return out

    first = meet(asked, positives_in, "anchor_id long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    positives = first.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n_positives)
    block = F.pmod(F.xxhash64("anchor_id"), F.lit(n_anchor_blocks)).cast("int")
    positives = positives.groupBy(block.alias("anchors")).agg(F.collect_list(F.struct("anchor_id", "positive_id", "positive_score", "place")).alias("positives"))
    asked = written(asked.join(positives, "anchors"), "negatives-positives")
    found = meet(asked, negatives_in, "anchor_id long, positive_id long, positive_score long, place int, negative_id long, negative_score long")
    order = Window.partitionBy("anchor_id", "place").orderBy(F.desc("negative_score"), "negative_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n_negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
