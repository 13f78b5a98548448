"""Token counts, keywords and keyness, per group and window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import FUNCTION_WORDS, ngrams
from .windows import PlacedRows


def in_blocks(by: list[str]) -> list[str]:
    """Keys of windows as those of blocks."""
    return [c for c in by if c != "window_no"]


def token_counts(df: DataFrame | PlacedRows, by: list[str] = (), tokens: str = "tokens") -> DataFrame:
    """by, word, n. Partial sums keep the shuffle at vocabulary size."""
    if isinstance(df, PlacedRows):
        keys = in_blocks(by)
        return df.sums(token_counts(df.blocks(), [*keys, "_block", "_windows"], tokens), [*keys, "word"], ["n"]).select(*by, "word", "n")
    return df.select(*by, F.explode(tokens).alias("word")).groupBy(*by, "word").agg(F.count(F.lit(1)).alias("n"))


def top_tokens(df: DataFrame, n: int, tokens: str = "tokens") -> DataFrame:
    return token_counts(df, tokens=tokens).orderBy(F.desc("n"), "word").limit(n)


def lr_of(c1: Column, n1: Column, c2: Column, n2: Column) -> Column:
    """Log ratio with half a count added to each count; null where a corpus is empty."""
    return F.when((n1 > 0) & (n2 > 0), F.log2((c1 + 0.5) / n1) - F.log2((c2 + 0.5) / n2))


def ll_of(c1: Column, n1: Column, c2: Column, n2: Column) -> Column:
    """Log likelihood of two counts; 0 ln 0 = 0."""
    part = lambda c, n: F.when(c > 0, c * F.ln(c * (n1 + n2) / (n * (c1 + c2)))).otherwise(0.0)
    return 2 * (part(c1, n1) + part(c2, n2))


def paired_counts(df: DataFrame | PlacedRows, target: Column, by: list[str] = (), tokens: str = "tokens", reference: Column | None = None) -> DataFrame:
    """by, word, c1, c2, n1, n2: counts in rows of the target and in the reference (all other rows), in one pass."""
    if isinstance(df, PlacedRows):
        keys = in_blocks(by)
        counts = df.sums(counts_of_pairs(df.blocks(), target, [*keys, "_block", "_windows"], tokens, reference), [*keys, "word"], ["c1", "c2"]).select(*by, "word", "c1", "c2")
    else:
        counts = counts_of_pairs(df, target, list(by), tokens, reference)
    return with_totals(counts, by)


def counts_of_pairs(df: DataFrame, target: Column, by: list[str], tokens: str, reference: Column | None) -> DataFrame:
    other = ~target if reference is None else reference
    words = df.select(*by, F.coalesce(target, F.lit(False)).alias("_t"), F.coalesce(other, F.lit(False)).alias("_r"), F.explode(tokens).alias("word")).filter("_t or _r")
    return words.groupBy(*by, "word").agg(F.sum(F.col("_t").cast("long")).alias("c1"), F.sum(F.col("_r").cast("long")).alias("c2"))


def with_totals(counts: DataFrame, by: list[str] = ()) -> DataFrame:
    """n1 and n2, the sums of c1 and c2. Without keys the totals are one row and joined to all, not gathered by a window."""
    sums = counts.groupBy(*by).agg(F.sum("c1").alias("n1"), F.sum("c2").alias("n2"))
    return counts.join(sums, list(by)) if by else counts.crossJoin(F.broadcast(sums))


def log_ratio(df: DataFrame, target: Column, by: list[str] = (), **options) -> DataFrame:
    """The log ratio of every word of target and reference: by, word, c1, c2, lr."""
    c = paired_counts(df, target, by, **options)
    return c.select(*by, "word", "c1", "c2", lr_of(F.col("c1"), F.col("n1"), F.col("c2"), F.col("n2")).alias("lr"))


def keywords(df: DataFrame, target: Column, by: list[str] = (), least_lr: float = 1.0, least_count: int = 10, **options) -> DataFrame:
    """Words with a target count above ``least_count`` and a log ratio above ``least_lr``."""
    return log_ratio(df, target, by, **options).filter((F.col("c1") > least_count) & (F.col("lr") > least_lr))


def keyness(df: DataFrame, target: Column, n: int = 1, by: list[str] = (), tokens: str = "tokens") -> DataFrame:
    """Log ratio and log likelihood of n-grams."""
    df = df.withColumn("_grams", F.col(tokens) if n == 1 else ngrams(F.col(tokens), n))
    c = paired_counts(df, target, by, tokens="_grams")
    args = [F.col(x) for x in ("c1", "n1", "c2", "n2")]
    return c.select(*by, "word", "c1", "c2", lr_of(*args).alias("lr"), ll_of(*args).alias("ll"))


def group_keywords(df: DataFrame, flag: str = "in_subset", by: list[str] = ("group",), least_lr: float = 1.0, least_count: int = 10, corpus: DataFrame | None = None, **options) -> DataFrame:
    """Keywords of each group's subset against its other rows that are also frequent in the corpus."""
    found = keywords(df, F.col(flag), list(by), least_lr, least_count, **options)
    if corpus is None:
        return found
    common = token_counts(corpus).filter(F.col("n") > least_count).select("word")
    return found.join(common, "word", "left_semi").select(*found.columns)


def keyword_vocabulary(df: DataFrame, flag: str = "in_subset", least_lr: float = 1.0, least_corpus: int = 100, tokens: str = "tokens") -> DataFrame:
    """Feature words: key in the subset and frequent in the whole corpus."""
    k = keyness(df, F.col(flag), tokens=tokens)
    return k.filter((F.col("lr") > least_lr) & (F.col("c1") + F.col("c2") > least_corpus)).select("word", "lr", "ll")


def word_frequencies(windowed: DataFrame, vocabulary: DataFrame, by: list[str] = ("group", "window_no"), tokens: str = "tokens", total: str = "all", function_words: list[str] = FUNCTION_WORDS) -> DataFrame:
    """Relative frequencies of listed words per group and window, as sparse rows: by, word, n, value.

    ``total``: of all tokens, or of tokens that are no function words.
    """
    counts = token_counts(windowed, list(by), tokens)
    base = counts if total == "all" else counts.filter(~F.col("word").isin(list(function_words)))
    totals = base.groupBy(*by).agg(F.sum("n").alias("_total"))
    kept = counts.join(vocabulary.select("word").distinct(), "word", "left_semi")
    return kept.join(totals, list(by)).select(*by, "word", "n", (F.col("n") / F.col("_total")).alias("value"))


def block_counts(df: DataFrame, size: int, step: int, by: list[str], position: str = "position", tokens: str = "tokens", total: str = "_total") -> DataFrame:
    """Counts per overlapping window of rows with their global ``position``: by, window_no, word, n."""
    rows = df.withColumn("position", F.col(position)).withColumn("_total", F.col(total))
    return token_counts(PlacedRows(rows, size, step), [*by, "window_no"], tokens)


def window_keywords(windowed: DataFrame, flag: str = "in_subset", by: list[str] = ("group", "window_no"), least_lr: float = 1.0, least_count: int = 10, tokens: str = "tokens") -> DataFrame:
    """Keywords of the subset within each group and window; value is the count."""
    k = keywords(windowed, F.col(flag), list(by), least_lr, least_count, tokens=tokens)
    return k.select(*by, "word", F.col("c1").alias("value"), "lr")


def window_keywords_shared(windowed: DataFrame, flag: str = "in_subset", least_lr: float = 1.0, least_count: int = 10, own_only: bool = False, tokens: str = "tokens") -> DataFrame:
    """The window's keywords over all groups, valued by each group's relative frequency in its subset.

    ``own_only``: 0 where the group's own log ratio isn't above ``least_lr``.
    """
    own = log_ratio(windowed, F.col(flag), ["group", "window_no"], tokens=tokens)
    totals = own.groupBy("group", "window_no").agg(F.sum("c1").alias("_total"))
    every = own.groupBy("window_no", "word").agg(F.sum("c1").alias("c1"), F.sum("c2").alias("c2"))
    every = with_totals(every, ["window_no"])
    shared = every.filter((F.col("c1") > least_count) & (lr_of(F.col("c1"), F.col("n1"), F.col("c2"), F.col("n2")) > least_lr)).select("window_no", "word")
    rows = own.join(shared, ["window_no", "word"]).join(totals, ["group", "window_no"]).filter("c1 > 0")
    value = F.col("c1") / F.col("_total")
    if own_only:
        value = F.when(F.col("lr") > least_lr, value).otherwise(F.lit(0.0))
    return rows.select("group", "window_no", "word", value.alias("value"))


def normalise(values: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Values as shares of their row's sum."""
    return values.withColumn(value, F.col(value) / F.sum(value).over(Window.partitionBy(*by)))


def align(a: DataFrame, b: DataFrame, window: str = "window_no") -> DataFrame:
    """Two sparse matrices over the union of their cells: window, word, a, b with 0 where one has none."""
    x, y = a.select(window, "word", F.col("value").alias("a")), b.select(window, "word", F.col("value").alias("b"))
    return x.join(y, [window, "word"], "full").na.fill(0.0, ["a", "b"])


def period_keywords(df: DataFrame, specs: dict[str, tuple[str, str]], least_lr: float = 1.0, least_count: int = 10, tokens: str = "tokens") -> DataFrame:
    """Keywords of many (target, reference) pairs in one scan: spec, word, c1, c2, lr.

    ``specs``: name to SQL predicates of target and reference. Words are counted once for
    each distinct pattern of predicates a row meets, and the patterns are then spread over the specs.
    """
    names = list(specs)
    marks = [F.coalesce(F.expr(p), F.lit(False)).alias(f"_{s}{i}") for i, n in enumerate(names) for s, p in zip("tr", specs[n])]
    flags = [f"_{s}{i}" for i in range(len(names)) for s in "tr"]
    counts = df.select(*marks, F.explode(tokens).alias("word")).groupBy(*flags, "word").agg(F.count(F.lit(1)).alias("n"))
    spread = F.explode(F.array(*[F.struct(F.lit(n).alias("spec"), F.col(f"_t{i}").cast("long").alias("t"), F.col(f"_r{i}").cast("long").alias("r")) for i, n in enumerate(names)]))
    per = counts.withColumn("s", spread).filter("s.t + s.r > 0").groupBy("s.spec", "word").agg(F.sum(F.col("n") * F.col("s.t")).alias("c1"), F.sum(F.col("n") * F.col("s.r")).alias("c2"))
    per = with_totals(per, ["spec"])
    lr = lr_of(F.col("c1"), F.col("n1"), F.col("c2"), F.col("n2"))
    return per.select("spec", "word", "c1", "c2", lr.alias("lr")).filter((F.col("c1") > least_count) & (F.col("lr") > least_lr))


def compare_keywords(a: DataFrame, b: DataFrame) -> DataFrame:
    """Words in both lists: lr_a, lr_b, lr_diff, rank_a, rank_b, rank_diff (ranks by falling log ratio in hundredths, then by word)."""

    def ranked(k: DataFrame, s: str) -> DataFrame:
        """Ranks inside ranges of ratios and of first letters, after all words of the ranges before."""
        k = k.select("word", "lr", F.round(-F.col("lr"), 2).alias("_r"), F.substring("word", 1, 2).alias("_w"))
        sizes = k.groupBy("_r", "_w").agg(F.count(F.lit(1)).alias("_n"))  # hundredths of a ratio and pairs of letters: few, whatever the vocabulary
        before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_r", "_w").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        place = F.row_number().over(Window.partitionBy("_r", "_w").orderBy("word"))
        return k.join(before, ["_r", "_w"]).select("word", F.col("lr").alias(f"lr_{s}"), (F.col("_before") + place).alias(f"rank_{s}"))

    j = ranked(a, "a").join(ranked(b, "b"), "word")
    return j.withColumn("lr_diff", F.col("lr_a") - F.col("lr_b")).withColumn("rank_diff", F.col("rank_a") - F.col("rank_b"))


def cluster_keywords(counts: DataFrame, least_count: int = 100, least_corpus: int = 100, least_lr: float = 1.0, top: int | None = None) -> DataFrame:
    """Keywords of each cluster of windows against the group's other clusters, from counts group, cluster, word, n."""
    c = counts.groupBy("group", "cluster", "word").agg(F.sum("n").alias("c1"))
    words = c.groupBy("group", "word").agg(F.sum("c1").alias("_all"))
    sizes = c.groupBy("group", "cluster").agg(F.sum("c1").alias("n1"))
    whole = sizes.groupBy("group").agg(F.sum("n1").alias("_whole"))
    j = c.join(words, ["group", "word"]).join(sizes, ["group", "cluster"]).join(whole, "group")
    j = j.withColumn("c2", F.col("_all") - F.col("c1")).withColumn("n2", F.col("_whole") - F.col("n1"))
    j = j.withColumn("lr", lr_of(F.col("c1"), F.col("n1"), F.col("c2"), F.col("n2")))
    j = j.filter((F.col("c1") > least_count) & (F.col("_all") > least_corpus) & (F.col("lr") > least_lr)).select("group", "cluster", "word", "c1", "c2", "lr")
    if top:
        j = j.withColumn("_n", F.row_number().over(Window.partitionBy("group", "cluster").orderBy(F.desc("lr"), "word"))).filter(F.col("_n") <= top).drop("_n")
    return j


def features_per_window(values: DataFrame, by: list[str] = ("group", "window_no")) -> DataFrame:
    return values.groupBy(*by).agg(F.count(F.lit(1)).alias("n_features"))


def bow_features(windowed: DataFrame, by: list[str] = ("group", "window_no"), top: int = 1000, vocabulary: DataFrame | None = None, function_words: list[str] = FUNCTION_WORDS, raw: bool = False, tokens: str = "tokens") -> DataFrame:
    """Frequencies of the corpus's top words per group and window over content totals: by, word, value (raw: counts and the total)."""
    counts = token_counts(windowed, list(by), tokens).filter(~F.col("word").isin(list(function_words)))
    if vocabulary is None:
        vocabulary = counts.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(top)
    totals = counts.groupBy(*by).agg(F.sum("n").alias("total"))
    rows = counts.join(vocabulary.select("word"), "word", "left_semi").join(totals, list(by))
    return rows.select(*by, "word", F.col("n").alias("value"), "total") if raw else rows.select(*by, "word", (F.col("n") / F.col("total")).alias("value"))
