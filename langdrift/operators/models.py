"""Snapshot bigram models: cross-entropy and divergence between groups and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bigrams

BACK_OFF = 0.4


def text_bigrams(texts: DataFrame, keep: list[str], tokens: str = "tokens") -> DataFrame:
    """keep, w1, w2, n: the padded bigrams of texts, counted within ``keep``."""
    rows = texts.select(*keep, F.explode(bigrams(F.col(tokens))).alias("b")).select(*keep, "b.w1", "b.w2")
    return rows.groupBy(*keep, "w1", "w2").agg(F.count(F.lit(1)).alias("n"))


def train_bigrams(texts: DataFrame, keys: list[str], tokens: str = "tokens") -> DataFrame:
    """Models: keys, w1, w2, n."""
    return text_bigrams(texts, keys, tokens)


def train_over_runs(texts: DataFrame, mask: str, runs: int, keys: list[str], tokens: str = "tokens") -> DataFrame:
    """Models of many runs in one pass: run, keys, w1, w2, n. Bit ``r`` of ``mask`` says whether run ``r`` has the text.

    Bigrams are counted for all runs side by side, and a row for each run comes after counting.
    """
    rows = occurrences(texts.filter(F.col(mask) != 0), [*keys, mask], tokens)
    counts = rows.groupBy(*keys, "w1", "w2").agg(F.array(*[F.sum(F.shiftrightunsigned(mask, r).bitwiseAND(F.lit(1))) for r in range(runs)]).alias("_n"))
    return counts.select(F.posexplode("_n").alias("run", "n"), *keys, "w1", "w2").filter("n > 0").select("run", *keys, "w1", "w2", "n")


def expand_runs(texts: DataFrame, mask: str, runs: int) -> DataFrame:
    """A row for each run whose bit is set in ``mask``."""
    return texts.withColumn("run", F.explode(F.array_compact(F.array(*[F.when(F.shiftrightunsigned(mask, r).bitwiseAND(F.lit(1)) == 1, F.lit(r)) for r in range(runs)]))))


def context_counts(model: DataFrame, keys: list[str]) -> DataFrame:
    """keys, w, ctx: how often a word is a bigram's first."""
    return model.groupBy(*keys, F.col("w1").alias("w")).agg(F.sum("n").alias("ctx"))


def seen_score(c: Column, ctx: Column, smoothing: float) -> Column:
    return (c + smoothing) / (ctx + smoothing)


def unseen_score(ctx_second: Column, total: Column, smoothing: float) -> Column:
    return BACK_OFF * (F.coalesce(ctx_second, F.lit(0)) + smoothing) / (total + smoothing)


def score_of(c: Column, ctx: Column, ctx_second: Column, total: Column, smoothing: float) -> Column:
    """(c + s) / (ctx + s) of a seen bigram, else 0.4 (ctx of the second word + s) / (total + s)."""
    return F.when(c > 0, seen_score(c, ctx, smoothing)).otherwise(unseen_score(ctx_second, total, smoothing))


def group_sizes(model: DataFrame, keys: list[str]) -> DataFrame:
    """keys, _groups: the groups with their number of bigrams, in order of their names."""
    sizes = model.groupBy(*keys, "group").agg(F.sum("n").alias("total"))
    return sizes.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("group", "total"))).alias("_groups"))


def score_bigrams(asked: DataFrame, model: DataFrame, keys: list[str], smoothing: float = 1.0) -> DataFrame:
    """keys, w1, w2, _scores: log2 of each distinct asked bigram's score under every group's model of its keys.

    ``model``: keys, group, w1, w2, n. A bigram is one row whatever the number of groups: what
    the groups have of it, and of its words as contexts, are maps by group. Scores stand in
    the order of ``group_sizes``; keys without a model are dropped.
    """
    by_group = lambda df, by, n: df.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("group", n))).alias(f"_{n}"))
    contexts = by_group(context_counts(model, [*keys, "group"]), [*keys, "w"], "ctx")
    j = asked.select(*keys, "w1", "w2").distinct().join(group_sizes(model, keys), keys)
    j = j.join(by_group(model, [*keys, "w1", "w2"], "n"), [*keys, "w1", "w2"], "left")
    j = j.join(contexts.withColumnRenamed("w", "w1"), [*keys, "w1"], "left")
    j = j.join(contexts.withColumnRenamed("w", "w2").withColumnRenamed("_ctx", "_second"), [*keys, "w2"], "left")
    of = lambda column, g: F.try_element_at(F.col(column), g["group"])
    scores = F.transform("_groups", lambda g: F.log2(score_of(of("_n", g), of("_ctx", g), of("_second", g), g["total"], smoothing)))
    return j.select(*keys, "w1", "w2", scores.alias("_scores"))


def in_one_group(model: DataFrame) -> DataFrame:
    """A model without groups as that of one group; rows of a null group are left out."""
    return model.filter(F.col("group").isNotNull()) if "group" in model.columns else model.withColumn("group", F.lit(""))


def cross_entropy(tests: DataFrame, model: DataFrame, keys: list[str], text: list[str], smoothing: float = 1.0) -> DataFrame:
    """Minus the mean log2 score of each text's bigrams under every group's model: keys, text, snap_group, ce.

    ``tests``: keys, text, w1, w2, and n if a row stands for n occurrences; ``model``: keys, group,
    w1, w2, n. Without groups there is no snap_group.
    """
    grouped, model = "group" in model.columns, in_one_group(model)
    weight = F.col("n") if "n" in tests.columns else F.lit(1)
    tests = tests.select(*keys, *text, "w1", "w2", weight.alias("_n"))
    scored = tests.join(score_bigrams(tests, model, keys, smoothing), [*keys, "w1", "w2"])
    sums = scored.groupBy(*keys, *text).agg(F.collect_list(F.struct("_n", "_scores")).alias("_all")).join(group_sizes(model, keys), keys)
    total = lambda i: F.aggregate("_all", F.lit(0.0), lambda s, x: s + x["_n"] * x["_scores"][i])
    number = F.aggregate("_all", F.lit(0).cast("long"), lambda s, x: s + x["_n"])
    each = F.transform("_groups", lambda g, i: F.struct(g["group"].alias("snap_group"), (-total(i) / number).alias("ce")))
    found = sums.select(*keys, *text, F.inline(each))
    return found if grouped else found.drop("snap_group")


def kl_divergence(q: DataFrame, p: DataFrame, keys: list[str], smoothing: float = 1.0) -> DataFrame:
    """KL(P || Q) of every pair of groups with the same keys: keys, q_group, p_group, kld.

    Over the union of both models' bigrams, scores normalised, natural logarithm. ``q``, ``p``:
    keys, group, w1, w2, n, where rows may repeat a bigram (their n are summed); without groups there are none in the result. With normalised scores the divergence is
    sum(p ln(p / q)) / sum(p) + ln(sum(q) / sum(p)), and all three sums close over second words: a
    bigram that one model lacks scores there by its second word only. So each model's seen
    bigrams are summed by second word, as if the other had none of them; bigrams that both
    have, summed by second word too, correct that. Pairs of groups meet once a word, never once a bigram.
    """
    grouped = "group" in q.columns
    mark = lambda df, side: in_one_group(df).select(*keys, F.lit(side).alias("side"), "group", "w1", "w2", "n")
    own = [*keys, "side", "group"]
    # dealt out by first word, where counts, contexts and what both models have are made without another shuffle
    dealt = mark(q, "q").unionByName(mark(p, "p")).repartition(*keys, "w1")
    model = dealt.groupBy(*own, "w1", "w2").agg(F.sum("n").alias("n"))
    contexts = context_counts(model, own)
    counted = model.withColumn("ctx", F.sum("n").over(Window.partitionBy(*own, "w1")))
    score = seen_score(F.col("n"), F.col("ctx"), smoothing)
    seen = counted.select(*own, "w1", "w2", score.alias("s"))
    # of a word: as second word of each model's bigrams, and as a context of each model; whole numbers are shuffled, of which scores are made there
    by_second = counted.select(*own, F.col("w2").alias("w"), "n", "ctx").repartition(*keys, "w").select(*own, "w", score.alias("s"))
    second = by_second.groupBy(*own, "w").agg(F.count(F.lit(1)).alias("n"), F.sum("s").alias("s"), F.sum(F.ln("s")).alias("ln"), F.sum(F.col("s") * F.ln("s")).alias("sln"), F.lit(0).cast("long").alias("ctx"))
    first = contexts.select(*own, "w", *(F.lit(0).cast(t).alias(c) for c, t in (("n", "long"), ("s", "double"), ("ln", "double"), ("sln", "double"))), "ctx").repartition(*keys, "w")
    parts = second.select(*own, "w", "n", "s", "ln", "sln", "ctx").union(first).groupBy(*own, "w").agg(*[F.sum(c).alias(c) for c in ("n", "s", "ln", "sln", "ctx")])
    words = parts.groupBy(*keys, "w").agg(F.map_from_entries(F.collect_list(F.struct(F.struct("side", "group"), F.struct("n", "s", "ln", "sln", "ctx")))).alias("_parts"))
    have = seen.groupBy(*keys, "w1", "w2").agg(F.collect_list(F.struct("side", "group", "s")).alias("_have"))
    having = lambda side: F.filter("_have", lambda m: m["side"] == side)
    both = have.select(*keys, "w2", F.inline(F.flatten(F.transform(having("q"), lambda a: F.transform(having("p"), lambda b: F.struct(a["group"].alias("q"), b["group"].alias("p"), a["s"].alias("sq"), b["s"].alias("sp")))))))
    both = both.groupBy(*keys, F.col("w2").alias("w"), "q", "p").agg(F.count(F.lit(1)).alias("n"), F.sum("sp").alias("s"), F.sum(F.ln("sq")).alias("ln"), F.sum(F.col("sp") * F.ln("sq")).alias("sln"))
    both = both.groupBy(*keys, "w").agg(F.map_from_entries(F.collect_list(F.struct(F.struct("q", "p"), F.struct("n", "s", "ln", "sln")))).alias("_both"))
    sizes = contexts.groupBy(*own).agg(F.sum("ctx").alias("total")).groupBy(*keys).agg(F.collect_list(F.struct("side", "group", "total")).alias("_models"))
    models = lambda side: F.filter("_models", lambda m: m["side"] == side)
    pairs = F.explode(F.flatten(F.transform(models("q"), lambda a: F.transform(models("p"), lambda b: F.struct(a.alias("q"), b.alias("p"))))))
    rows = words.join(both, [*keys, "w"], "left").join(sizes, keys).withColumn("_pair", pairs)
    of = lambda side: F.try_element_at("_parts", F.struct(F.lit(side).alias("side"), F.col(f"_pair.{side}.group").alias("group")))
    rows = rows.select(*keys, F.col("_pair.q.group").alias("q_group"), F.col("_pair.p.group").alias("p_group"), of("q").alias("q"), of("p").alias("p"), F.try_element_at("_both", F.struct(F.col("_pair.q.group").alias("q"), F.col("_pair.p.group").alias("p"))).alias("b"), F.col("_pair.q.total").alias("q_total"), F.col("_pair.p.total").alias("p_total"))
    rows = rows.withColumn("bq", unseen_score(F.col("q.ctx"), F.col("q_total"), smoothing)).withColumn("bp", unseen_score(F.col("p.ctx"), F.col("p_total"), smoothing))
    c = lambda name: F.coalesce(F.col(name), F.lit(0))
    ln_q, ln_p = F.ln("bq"), F.ln("bp")
    sum_p = c("p.s") + (c("q.n") - c("b.n")) * F.col("bp")
    sum_q = c("q.s") + (c("p.n") - c("b.n")) * F.col("bq")
    # bigrams of P that Q lacks or has, then bigrams of Q that P lacks
    cross = c("p.sln") - (c("p.s") - c("b.s")) * ln_q - c("b.sln") + F.col("bp") * ((c("q.n") - c("b.n")) * ln_p - (c("q.ln") - c("b.ln")))
    sums = rows.groupBy(*keys, "q_group", "p_group").agg(F.sum(sum_q).alias("_sq"), F.sum(sum_p).alias("_sp"), F.sum(cross).alias("_s"))
    return sums.select(*keys, *(["q_group", "p_group"] if grouped else []), (F.col("_s") / F.col("_sp") + F.ln(F.col("_sq") / F.col("_sp"))).alias("kld"))


def occurrences(texts: DataFrame, keep: list[str], tokens: str = "tokens") -> DataFrame:
    """keep, w1, w2: the padded bigrams of texts, a row each."""
    return texts.select(*keep, F.explode(bigrams(F.col(tokens))).alias("b")).select(*keep, "b.w1", "b.w2")


def ce_matrix(sampled: DataFrame, smoothing: float = 1.0, text: str = "uid", shift: int = 0, same_group: bool = False, tokens: str = "tokens") -> DataFrame:
    """Cross-entropy of each test group's texts under each group's snapshot of the same run and window.

    ``sampled``: run, window_no, group, role, uid, tokens. ``shift``: test texts of window i + shift on the
    snapshot of window i. Result: run, window_no, snap_group, test_group, uid, ce.
    """
    model = train_bigrams(sampled.filter("role = 'snapshot'"), ["run", "window_no", "group"], tokens)
    return compare_texts(model, sampled.filter("role = 'test'"), smoothing, text, shift, same_group, tokens)


def compare_texts(model: DataFrame, tests: DataFrame, smoothing: float = 1.0, text: str = "uid", shift: int = 0, same_group: bool = False, tokens: str = "tokens") -> DataFrame:
    """``ce_matrix`` from models (run, window_no, group, w1, w2, n) and test texts (run, window_no, group, uid, tokens)."""
    keys = ["run", "window_no"]
    tests = tests.withColumn("window_no", F.col("window_no") - shift).withColumnRenamed("group", "test_group")
    found = cross_entropy(occurrences(tests, [*keys, "test_group", text], tokens), model, keys, ["test_group", text], smoothing)
    found = found.filter("snap_group = test_group") if same_group else found
    return found.select(*keys, "snap_group", "test_group", text, "ce")


def next_window(found: DataFrame) -> DataFrame:
    """A comparison with the window before as that of the window itself, of one group."""
    return found.withColumn("window_no", F.col("window_no") + 1).withColumnRenamed("snap_group", "group").drop("test_group")


def ce_fluctuation(sampled: DataFrame, smoothing: float = 1.0, **options) -> DataFrame:
    """The snapshot of window i on test texts of window i + 1 of the same group; window_no is i + 1's."""
    return next_window(ce_matrix(sampled, smoothing, shift=1, same_group=True, **options))


def kld_matrix(sampled: DataFrame, smoothing: float = 1.0, roles: tuple[str, str] = ("snapshot", "test"), tokens: str = "tokens") -> DataFrame:
    """Divergence of each test model from each snapshot model per run and window: run, window_no, snap_group, test_group, kld."""
    q, p = (occurrences(sampled.filter(F.col("role") == r), ["run", "window_no", "group"], tokens).withColumn("n", F.lit(1).cast("long")) for r in roles)
    return compare_models(q, p, smoothing)


def compare_models(q: DataFrame, p: DataFrame, smoothing: float = 1.0) -> DataFrame:
    """``kld_matrix`` from models (run, window_no, group, w1, w2, n)."""
    return kl_divergence(q, p, ["run", "window_no"], smoothing).withColumnsRenamed({"q_group": "snap_group", "p_group": "test_group"})


def kld_fluctuation(sampled: DataFrame, smoothing: float = 1.0, role: str = "test", tokens: str = "tokens") -> DataFrame:
    """Divergence of a window's model from the snapshot of the window before, per run and group."""
    q, p = (occurrences(sampled.filter(F.col("role") == r), ["run", "window_no", "group"], tokens).withColumn("n", F.lit(1).cast("long")) for r in ("snapshot", role))
    return compare_with_window_before(q, p, smoothing)


def compare_with_window_before(q: DataFrame, p: DataFrame, smoothing: float = 1.0) -> DataFrame:
    """``kld_fluctuation`` from models (run, window_no, group, w1, w2, n)."""
    q, p = (df.withColumnRenamed("group", "_own") for df in (q.withColumn("window_no", F.col("window_no") + 1), p))
    return kl_divergence(q, p, ["run", "window_no", "_own"], smoothing).withColumnRenamed("_own", "group")


def snapshot_cross_entropy(tests: DataFrame, snapshots: DataFrame, smoothing: float = 1.0, text: str = "uid", tokens: str = "tokens") -> DataFrame:
    """Cross-entropy of dated texts under the snapshot named in ``snapshot_no`` (see ``windows.snapshot_for``)."""
    model = train_bigrams(snapshots, ["window_no"], tokens).withColumnRenamed("window_no", "snapshot_no")
    return cross_entropy(occurrences(tests, ["snapshot_no", text], tokens), model, ["snapshot_no"], [text], smoothing)


def run_means(ce: DataFrame, by: list[str] = ("snap_group", "test_group")) -> DataFrame:
    """Mean and deviation inside each run and window."""
    return ce.groupBy("run", "window_no", *by).agg(F.avg("ce").alias("mean_ce"), F.stddev_samp("ce").alias("std_ce"), F.count(F.lit(1)).alias("n_texts"))


def mean_std(means: DataFrame, by: list[str] = ("snap_group", "test_group")) -> DataFrame:
    """Mean and deviation across runs."""
    return means.groupBy("window_no", *by).agg(F.avg("mean_ce").alias("mean"), F.stddev_samp("mean_ce").alias("std"), F.count(F.lit(1)).alias("n_runs"))


def ace_difference(means: DataFrame, snap: str, test: str) -> DataFrame:
    """Mean of ``test`` on ``snap`` less that of ``snap`` on itself, per run and window."""
    pick = lambda s, t, n: means.filter((F.col("snap_group") == s) & (F.col("test_group") == t)).select("run", "window_no", F.col("mean_ce").alias(n))
    j = pick(snap, test, "_a").join(pick(snap, snap, "_b"), ["run", "window_no"])
    return j.select("run", "window_no", (F.col("_a") - F.col("_b")).alias("difference"))
