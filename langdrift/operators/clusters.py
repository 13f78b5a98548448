"""Variability-based neighbour clustering of windows."""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import stored


def merge_neighbours(matrix: np.ndarray) -> list[tuple[int, int, float, int]]:
    """``merge_by_products`` of windows' vectors."""
    return merge_by_products(matrix @ matrix.T)


def merge_by_products(products: np.ndarray) -> list[tuple[int, int, float, int]]:
    """Linkage rows (a, b, height, size): repeatedly merges the adjacent clusters whose mean vectors have the highest cosine.

    ``products``: inner products of the windows' vectors, of which a merged cluster's are sums.
    Cluster i < n is window i; row r makes cluster n + r.
    """
    g = np.array(products, float)

    def join(a, b):
        g[a] += g[b]
        g[:, a] += g[:, b]

    return merge_adjacent(len(g), lambda a, b: g[a, b], join)


def merge_by_vectors(vectors: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int, float, int]]:
    """``merge_by_products`` of sparse vectors (places in order, values), of which a merged cluster's is the sum; no products of windows that never meet."""
    vectors = list(vectors)

    def product(a, b):
        (x, v), (y, w) = vectors[a], vectors[b]
        if a == b:
            return float(v @ v)
        if len(x) == len(y) and (x == y).all():
            return float(v @ w)
        at = np.searchsorted(y, x)
        hit = np.flatnonzero(at < len(y))
        hit = hit[y[at[hit]] == x[hit]]
        return float(v[hit] @ w[at[hit]])

    def join(a, b):
        (x, v), (y, w) = vectors[a], vectors[b]
        vectors[b] = None
        if len(x) == len(y) and (x == y).all():
            vectors[a] = x, v + w
        else:
            places, back = np.unique(np.concatenate([x, y]), return_inverse=True)
            vectors[a] = places, np.bincount(back, np.concatenate([v, w]), len(places))

    return merge_adjacent(len(vectors), product, join)


def merge_adjacent(n: int, product, join) -> list[tuple[int, int, float, int]]:
    """Linkage rows of n clusters in a row: ``product`` (a, b) of their vectors, ``join`` (a, b) makes a the sum of both. Of equal gaps the first is merged."""
    ids, sizes, before, after = list(range(n)), [1] * n, list(range(-1, n - 1)), list(range(1, n + 1))
    age, own, out = [0] * n, [product(i, i) for i in range(n)], []

    def gap(a, b):
        size = np.sqrt(own[a]) * np.sqrt(own[b])
        return float(1 - product(a, b) / size) if size else 1.0

    heap = [(gap(i, i + 1), i, i + 1, 0, 0) for i in range(n - 1)]
    heapq.heapify(heap)
    while heap:
        height, a, b, *ages = heapq.heappop(heap)
        if ages != [age[a], age[b]]:
            continue
        out.append((ids[a], ids[b], max(height, 0.0), sizes[a] + sizes[b]))
        join(a, b)
        ids[a], sizes[a], own[a], after[a] = n + len(out) - 1, sizes[a] + sizes[b], product(a, a), after[b]
        age[a] += 1
        age[b] = -1
        if after[a] < n:
            before[after[a]] = a
            heapq.heappush(heap, (gap(a, after[a]), a, after[a], age[a], age[after[a]]))
        if before[a] >= 0:
            heapq.heappush(heap, (gap(before[a], a), before[a], a, age[before[a]], age[a]))
    return out


#: So many words of a group meet in one task.
WORDS = 4096


def inner_products(features: DataFrame, by: str = "group") -> DataFrame:
    """by, window_no, place (in the order of windows, from 0), products: of each window's vector with those of all windows of its group.

    ``features``: by, window_no, word, value; repeated cells are summed. Words are dealt into buckets, so no
    task holds a group's vectors; what a bucket gives to a window's products is summed where the
    window is.
    """
    return products_of_cells(cells_of(features, by), by)


def cells_of(features: DataFrame, by: str) -> DataFrame:
    """by, window_no, word, value as a table; repeated cells are summed."""
    return stored(features.filter(F.col(by).isNotNull()).groupBy(by, "window_no", "word").agg(F.sum(F.col("value").cast("double")).alias("value")), "cluster-cells")


def places_of(cells: DataFrame, by: str) -> DataFrame:
    """by, window_no, place, n: the windows of each group in their order, from 0, and their number."""
    order = Window.partitionBy(by).orderBy("window_no")
    return cells.select(by, "window_no").distinct().withColumn("place", F.row_number().over(order) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(by)).cast("int"))


def products_of_cells(cells: DataFrame, by: str) -> DataFrame:
    """``inner_products`` of ``cells_of``."""
    types = dict(cells.dtypes)
    windows = places_of(cells, by)
    words = cells.groupBy(by).agg(F.ceil(F.count_distinct("word") / WORDS).alias("_buckets"))
    dealt = cells.join(windows, [by, "window_no"]).join(words, by).withColumn("bucket", F.pmod(F.xxhash64("word"), F.col("_buckets")))

    def part(key, pdf):
        import pandas as pd

        codes, known = pd.factorize(pdf["word"])
        matrix = np.zeros((int(pdf["n"].iloc[0]), len(known)))
        matrix[pdf["place"].to_numpy(), codes] = pdf["value"].to_numpy()
        have = np.flatnonzero(matrix.any(axis=1))
        return pd.DataFrame({by: key[0], "place": have, "products": list((matrix @ matrix.T)[have])})

    parts = dealt.groupBy(by, "bucket").applyInPandas(part, f"`{by}` {types[by]}, place int, products array<double>")

    def add(frames):
        import pandas as pd

        sums: dict = {}
        for pdf in frames:
            for key, products in zip(zip(pdf[by], pdf["place"].tolist()), pdf["products"]):
                sums[key] = sums[key] + products if key in sums else np.array(products)
        if sums:
            yield pd.DataFrame([(*k, list(v)) for k, v in sums.items()], columns=[by, "place", "products"])

    summed = parts.repartition(F.col(by), F.col("place")).mapInPandas(add, parts.schema)
    zeros = F.array_repeat(F.lit(0.0), F.col("n"))
    found = windows.join(summed.withColumnRenamed("place", "_place"), (F.col("place") == F.col("_place")) & (windows[by] == summed[by]), "left")
    return found.select(windows[by], "window_no", "place", F.coalesce("products", zeros).alias("products"))


def sparse_rows(cells: DataFrame, by: str) -> DataFrame:
    """by, window_no, place, n, codes, values: a row for each window of ``cells_of``; words are numbered within a group, in order of the words."""
    codes = cells.select(by, "word").distinct().withColumn("code", F.row_number().over(Window.partitionBy(by).orderBy("word")) - 1)
    packed = cells.join(codes, [by, "word"]).groupBy(by, "window_no").agg(F.array_sort(F.collect_list(F.struct("code", "value"))).alias("_c"))
    return packed.join(places_of(cells, by), [by, "window_no"]).select(by, "window_no", "place", "n", F.col("_c.code").alias("codes"), F.col("_c.value").alias("values"))


#: Windows in a block of products, and words.
BLOCK, COLUMNS = 1024, 4096


def block_products(a: list[tuple[np.ndarray, np.ndarray]], b: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Inner products of two lists of sparse vectors; ``COLUMNS`` words at a time."""
    out = np.zeros((len(a), len(b)))
    words = np.unique(np.concatenate([c for c, _ in a]))

    def dense(rows, columns):
        m = np.zeros((len(rows), len(columns)))
        for i, (c, v) in enumerate(rows):
            at = np.searchsorted(columns, c)
            hit = np.flatnonzero(at < len(columns))
            hit = hit[columns[at[hit]] == c[hit]]
            m[i, at[hit]] = v[hit]
        return m

    for k in range(0, len(words), COLUMNS):
        out += dense(a, words[k : k + COLUMNS]) @ dense(b, words[k : k + COLUMNS]).T
    return out


def pair_products(features: DataFrame, by: str = "group") -> DataFrame:
    """by, window_no, others, products: of windows' vectors with those of blocks of windows of their group, which blocks make all.

    A task holds two blocks of windows, whatever their number.
    """
    cells = cells_of(features, by)
    types = dict(cells.dtypes)
    rows = sparse_rows(cells, by).withColumn("_b", F.floor(F.col("place") / BLOCK).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / BLOCK).cast("int"))).alias("_o")
    dealt = rows.select(by, "window_no", "codes", "values", "_b", other).withColumn("_low", F.least("_b", "_o")).withColumn("_high", F.greatest("_b", "_o"))

    def run(key, pdf):
        import pandas as pd

        sides = [pdf[pdf["_b"] == k] for k in key[1:]]
        (x, a), (y, b) = (([*zip(own["codes"], own["values"])], own["window_no"].to_numpy()) for own in sides)
        products = block_products(x, y)
        own = pd.DataFrame({by: key[0], "window_no": a, "others": [b] * len(a), "products": list(products)})
        return own if key[1] == key[2] else pd.concat([own, pd.DataFrame({by: key[0], "window_no": b, "others": [a] * len(b), "products": list(products.T)})])

    window = types["window_no"]
    return dealt.groupBy(by, "_low", "_high").applyInPandas(run, f"`{by}` {types[by]}, window_no {window}, others array<{window}>, products array<double>")


def each_group(features: DataFrame, by: str, of_products, of_vectors, schema: str) -> DataFrame:
    """What functions of a group's (key, windows, products or sparse vectors) make: products where these are fewer than the group's cells, else vectors.

    So a task of a group holds no more than its cells, and no more than its products.
    """
    cells = cells_of(features, by)
    shape = cells.groupBy(by).agg(F.countDistinct("window_no").alias("_n"), F.count(F.lit(1)).alias("_cells"))
    many = F.col("_n") * F.col("_n") > F.col("_cells")

    def square(key, pdf):
        pdf = pdf.sort_values("place")
        return of_products(key[0], pdf["window_no"].tolist(), np.stack(pdf["products"].to_numpy()))

    def sparse(key, pdf):
        pdf = pdf.sort_values("place")
        return of_vectors(key[0], pdf["window_no"].tolist(), [*zip(pdf["codes"], pdf["values"])])

    few = products_of_cells(cells.join(shape.filter(~many), by, "left_semi"), by).groupBy(by).applyInPandas(square, schema)
    return few.unionByName(sparse_rows(cells.join(shape.filter(many), by, "left_semi"), by).groupBy(by).applyInPandas(sparse, schema))


def vnc(features: DataFrame, by: str = "group") -> DataFrame:
    """The linkage of each group's windows: by, step, a, b, height, size. ``features``: by, window_no, word, value.

    A group brings the inner products of its windows to a task, or its windows' vectors if these are smaller.
    """

    def made(merge):
        def run(key, windows, values):
            import pandas as pd

            return pd.DataFrame([(key, i, *r) for i, r in enumerate(merge(values))], columns=[by, "step", "a", "b", "height", "size"])

        return run

    return each_group(features, by, made(merge_by_products), made(merge_by_vectors), f"`{by}` {dict(features.dtypes)[by]}, step int, a int, b int, height double, size int")


def cut(links: list[tuple], n: int, threshold: float) -> list[int]:
    """Cluster number of each window, in order from 1: merges up to ``threshold`` hold."""
    parent = list(range(n + len(links)))

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for r, (a, b, height, _) in enumerate(links):
        if height <= threshold:
            parent[root(a)] = parent[root(b)] = n + r
    numbers: dict[int, int] = {}
    return [numbers.setdefault(root(i), len(numbers) + 1) for i in range(n)]


def vnc_clusters(features: DataFrame, threshold: float, by: str = "group") -> DataFrame:
    """by, window_no, cluster."""

    def made(merge):
        def run(key, windows, values):
            import pandas as pd

            return pd.DataFrame({by: key, "window_no": windows, "cluster": cut(merge(values), len(windows), threshold)})

        return run

    types = dict(features.dtypes)
    return each_group(features, by, made(merge_by_products), made(merge_by_vectors), f"`{by}` {types[by]}, window_no {types['window_no']}, cluster int")


def cophenetic_correlation(matrix: np.ndarray) -> float:
    """``correlation_by_products`` of windows' vectors."""
    return correlation_by_products(matrix @ matrix.T)


def correlation_by_products(products: np.ndarray) -> float:
    """Correlation of the tree's merge heights with the windows' Euclidean distances; nan below three windows."""
    products = np.asarray(products, float)
    return correlation_of(merge_by_products(products), np.diag(products), lambda x, y: products[x, y])


def correlation_by_vectors(vectors: list[tuple[np.ndarray, np.ndarray]]) -> float:
    """``correlation_by_products`` of sparse vectors; products are made a block at a time."""
    return correlation_of(merge_by_vectors(vectors), np.array([float(v @ v) for _, v in vectors]), lambda x, y: block_products(vectors[x], vectors[y]))


def correlation_of(links: list[tuple], own: np.ndarray, products) -> float:
    """Correlation of merge heights with distances. ``own``: squared norms; ``products`` of two slices of windows.

    Windows that meet in a merge are two neighbouring stretches, all pairs of which have its height, so
    distances are summed merge by merge, in blocks.
    """
    n = len(own)
    if n < 3:
        return float("nan")
    spans, merges = {i: (i, i + 1) for i in range(n)}, []
    for r, (a, b, height, _) in enumerate(links):
        (begin, middle), (_, end) = spans.pop(a), spans.pop(b)
        spans[n + r] = begin, end
        merges.append((begin, middle, end, height))
    number = np.array([(m - b) * (e - m) for b, m, e, _ in merges], float)
    heights = np.array([h for *_, h in merges])
    heights = heights - number @ heights / number.sum()
    start, first, second, both = None, 0.0, 0.0, 0.0
    for (begin, middle, end, _), height in zip(merges, heights):
        for i in range(begin, middle, BLOCK):
            for j in range(middle, end, BLOCK):
                x, y = slice(i, min(i + BLOCK, middle)), slice(j, min(j + BLOCK, end))
                far = np.sqrt(np.maximum(own[x, None] + own[None, y] - 2 * products(x, y), 0))
                start = far[0, 0] if start is None else start  # sums of what is near 0 lose no digits
                far -= start
                first, second, both = first + far.sum(), second + (far * far).sum(), both + height * far.sum()
    spread = (number @ (heights * heights)) * (second - first * first / number.sum())
    return float(both / np.sqrt(spread)) if spread > 0 else float("nan")


def cophenetic(features: DataFrame, by: str = "group") -> DataFrame:
    """by, correlation."""

    def made(correlation):
        def run(key, windows, values):
            import pandas as pd

            return pd.DataFrame({by: [key], "correlation": [correlation(values)]})

        return run

    return each_group(features, by, made(correlation_by_products), made(correlation_by_vectors), f"`{by}` {dict(features.dtypes)[by]}, correlation double")
