"""Repeatable sampling of members and texts for snapshot models.

Everything random is an order by a seeded hash, so results don't depend on partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(seed: int, *columns: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def with_runs(df: DataFrame, runs: int) -> DataFrame:
    """A copy of each row for every run."""
    return df.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))


def split_members(members: DataFrame, runs: int, share: float = 0.6, seed: int = 0, balance: bool = False) -> DataFrame:
    """group, member to run, group, member, role: the first int((n + 1) * share) in hash order are snapshot, the rest test.

    ``balance`` cuts each role to the smallest group's number.
    """
    rows = with_runs(members.select("group", "member").distinct(), runs)
    key = Window.partitionBy("run", "group")
    rows = rows.withColumn("_rank", F.row_number().over(key.orderBy(hash_order(seed, "run", "group", "member"), "member"))).withColumn("_n", F.count(F.lit(1)).over(key))
    cut = F.floor((F.col("_n") + 1) * share)
    rows = rows.withColumn("role", F.when(F.col("_rank") <= cut, "snapshot").otherwise("test")).withColumn("_place", F.when(F.col("_rank") <= cut, F.col("_rank")).otherwise(F.col("_rank") - cut))
    if balance:
        sizes = rows.groupBy("run", "group", "role").agg(F.count(F.lit(1)).alias("_s")).groupBy("run", "role").agg(F.min("_s").alias("_least"))
        rows = rows.join(sizes, ["run", "role"]).filter(F.col("_place") <= F.col("_least"))
    return rows.select("run", "group", "member", "role")


def cap_per_member(texts: DataFrame, n: int | None, seed: int = 0, by: list[str] = ("run", "window_no", "group", "role", "member"), uid: str = "uid") -> DataFrame:
    """At most ``n`` texts of a member per run, window, group and role."""
    if n is None:
        return texts
    order = Window.partitionBy(*by).orderBy(hash_order(seed, *by, uid), uid)
    return texts.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= n).drop("_n")


def sample_texts(texts: DataFrame, split: DataFrame, cap: int | None = None, seed: int = 0) -> DataFrame:
    """Windowed texts (group, member, window_no, uid) of the split's members, capped."""
    return cap_per_member(texts.join(split, ["group", "member"]), cap, seed)


def reference_split(texts: DataFrame, split: DataFrame, name: str = "Reference") -> DataFrame:
    """Texts of the reference corpus by the members' roles, merged over groups into one; a member's first role counts."""
    roles = split.groupBy("run", "member").agg(F.min("role").alias("role"))
    return texts.drop("group").join(roles, "member").withColumn("group", F.lit(name))


def snapshot_user_sample(windowed: DataFrame, users: int, per_user: int, tests: int, seed: int = 0) -> DataFrame:
    """Per group and window: ``users`` members with at least ``per_user`` texts, that many texts each (snapshot); ``tests`` texts of others.

    Takes what exists where there are fewer. Result: the rows with ``role``.
    """
    key = ["group", "window_no"]
    sizes = windowed.groupBy(*key, "member").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= per_user)
    chosen = sizes.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(hash_order(seed, *key, "member"), "member"))).filter(F.col("_r") <= users).select(*key, "member")
    place = lambda by: F.row_number().over(Window.partitionBy(*by).orderBy(hash_order(seed, *key, "uid"), "uid"))
    snapshot = windowed.join(chosen, [*key, "member"]).withColumn("_r", place([*key, "member"])).filter(F.col("_r") <= per_user)
    test = windowed.join(chosen, [*key, "member"], "left_anti").withColumn("_r", place(key)).filter(F.col("_r") <= tests)
    return snapshot.select(*windowed.columns, F.lit("snapshot").alias("role")).unionByName(test.select(*windowed.columns, F.lit("test").alias("role")))


def sample_meta(sampled: DataFrame) -> DataFrame:
    """Texts and members of each run, window, group and role."""
    return sampled.groupBy("run", "window_no", "group", "role").agg(F.count(F.lit(1)).alias("n_texts"), F.countDistinct("member").alias("n_members"))
