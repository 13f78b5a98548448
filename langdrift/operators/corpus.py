"""Assembling a corpus: joins, histories, versions, filters and groups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tails import similarity
from ..functions.text import lean


def in_period(df: DataFrame, start, end, date: str = "date", end_inclusive: bool = True) -> DataFrame:
    """Rows in [start, end], or [start, end) on request."""
    c = F.col(date)
    return df.filter((c >= F.lit(start)) & ((c <= F.lit(end)) if end_inclusive else (c < F.lit(end))))


def drop_members(df: DataFrame, excluded: list[int], member: str = "member") -> DataFrame:
    return df.filter(~F.col(member).isin(list(excluded))) if excluded else df


def drop_empty(df: DataFrame, text: str = "text", tokens: str | None = None) -> DataFrame:
    """Without empty texts and, given a token column, texts without tokens."""
    df = df.filter(F.length(text) > 0)
    return df.filter(F.size(tokens) > 0) if tokens else df


def drop_outdated(files: DataFrame, start, end, name: str = "file") -> DataFrame:
    """Files whose name holds a date in [start, end]."""
    date = F.regexp_extract(name, r"(\d{4}-\d{2}-\d{2})", 1).try_cast("date")
    return files.filter(date.between(F.lit(start), F.lit(end)))


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in a total order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def valid_contributions(df: DataFrame, order: list[str], uid: str = "uid", member: str = "member", text: str = "text", section_tag: str | None = "section_tag") -> DataFrame:
    """Rows with a uid, a member and more than one character, outside business without debate; first per uid."""
    df = df.filter(F.col(uid).isNotNull() & F.col(member).isNotNull() & (F.length(text) > 1))
    if section_tag:
        df = df.filter(F.coalesce(F.col(section_tag) != "hs_2BusinessWODebate", F.lit(True)))
    return first_by(df, [uid], *[F.col(c) for c in order])


def party_at(rows: DataFrame, intervals: DataFrame, uid: str = "uid", member: str = "member", value: str = "party") -> DataFrame:
    """``rows`` with the value in force on their date; open intervals have no end, the latest start wins on a change-over day."""
    i = intervals.select(F.col(member).alias("_m"), "start", "end", value)
    inside = (F.col("date") >= F.col("start")) & (F.col("end").isNull() | (F.col("date") <= F.col("end")))
    joined = rows.join(i, (F.col(member) == F.col("_m")) & inside)
    return first_by(joined, [uid], F.desc("start"), F.col(value)).drop("_m", "start", "end")


def build_corpus(contributions: DataFrame, members: DataFrame, debates: DataFrame, member_party: DataFrame, stances: DataFrame, start=None, end=None) -> DataFrame:
    """Contributions with member, date, party at that date and stances; members without stances are dropped.

    Sizes of the member tables are left to the planner: they are broadcast when small.
    """
    d = debates.select(F.col("uid").alias("debate"), "date")
    rows = contributions.join(d, "debate").join(members.select(F.col("pims_id").alias("member"), F.coalesce("display_name", "name").alias("name")), "member")
    rows = rows.join(stances.withColumnRenamed("pims_id", "member"), "member")
    if start is not None:
        rows = in_period(rows, start, end)
    return party_at(rows, member_party.withColumnRenamed("pims_id", "member"))


def constituency_at(history: DataFrame, date, member: str = "member", value: str = "constituency") -> DataFrame:
    """member, value in force on ``date``; the latest start wins."""
    inside = (F.col("start") <= F.lit(date)) & (F.col("end").isNull() | (F.col("end") >= F.lit(date)))
    return history.filter(inside).groupBy(member).agg(F.max_by(value, F.struct("start", value)).alias(value))


def latest_constituency(history: DataFrame, member: str = "member", value: str = "constituency") -> DataFrame:
    return history.groupBy(member).agg(F.max_by(value, F.struct("start", value)).alias(value))


def resolve_members(rows: DataFrame, members: DataFrame, member: str = "member", second: str = "mnis_id", third: str = "clerks_id") -> DataFrame:
    """Fills a missing member id (null or -1) through the second and then the third id; rows without any are dropped."""
    by = lambda key: members.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias(f"_{key}")).agg(F.min("pims_id").alias(f"_by_{key}"))
    joined = rows.join(by(second), F.col(second) == F.col(f"_{second}"), "left").join(by(third), F.col(third) == F.col(f"_{third}"), "left")
    own = F.when(F.col(member) != -1, F.col(member))
    return joined.withColumn(member, F.coalesce(own, f"_by_{second}", f"_by_{third}")).filter(F.col(member).isNotNull()).drop(*(f"{p}{k}" for k in (second, third) for p in ("_", "_by_")))


def match_fuzzy(left: DataFrame, right: DataFrame, key: str, result: str, name: str | None = None, least: int = 85, least_name: int = 50, least_alone: int = 95) -> DataFrame:
    """``left`` with ``result`` of the row of ``right`` with the same ``key``, or else of the one with the most similar key, if that is good enough; others are dropped.

    Equal keys need nothing more. Otherwise the most similar key (in lower case; the first in
    alphabetical order of equally similar ones) is found first, and then judged: without
    ``name`` it must exceed ``least``. With it, an empty or null name asks for more than
    ``least_alone``, any other for more than ``least`` and names (in lower case) that exceed
    ``least_name``. Of rows of ``right`` with one key the least result and its name count. Rows
    that repeat stay; null keys match nothing. The keys are compared by ``similar_keys``.
    """
    right = right.filter(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(result), *([F.col(name).alias("_name")] if name else []))
    order = [F.col(result), *([F.col("_name")] if name else [])]
    same = first_by(right, ["_key"], *order).select("_key", result)
    joined = left.join(same, F.col(key) == F.col("_key"), "left")
    equal = joined.filter(F.col("_key").isNotNull()).select(*left.columns, result)
    rest = left.join(same.select("_key"), F.col(key) == F.col("_key"), "left_anti").withColumn("_own", F.lower(key))
    folded = first_by(right.withColumn("_key", F.lower("_key")), ["_key"], *order)
    pairs = similar_keys(rest.select("_own"), folded.select("_key"), min(least, least_alone) if name else least)
    best = first_by(pairs, ["_own"], F.desc("_s"), F.col("_key"))
    close = rest.join(best, "_own").join(folded, "_key")
    if name:
        alone = F.coalesce(F.col(name), F.lit("")) == ""
        close = close.withColumn("_n", similarity(F.lower(name), F.lower("_name"))).filter((alone & (F.col("_s") > least_alone)) | (~alone & (F.col("_s") > least) & (F.col("_n") > least_name)))
    return equal.unionByName(close.select(*left.columns, result))


def least_common(own: Column, other: Column, least: int, q: int) -> Column:
    """Pieces of ``q`` neighbouring characters that two texts of these lengths have in common at least, if their similarity exceeds ``least``.

    Such texts have a common subsequence of some length L; of its L - q + 1 pieces each
    character that isn't in it parts at most q - 1.
    """
    need = F.ceil((least + 0.5) / 200 * (own + other) - 1e-6)
    return (2 * q - 1) * need - (q - 1) * (own + other + 1)


def piece_length(own: Column, other: Column, least: int) -> Column:
    """3 where similar texts of these lengths must have pieces of three characters in common, else 2."""
    return F.when(least_common(own, other, least, 3) > 0, 3).otherwise(2)


def key_prefixes(keys: DataFrame, c: str, least: int, frequent: DataFrame, q: int) -> DataFrame:
    """c, _size, _gram: the rarest numbered pieces of ``q`` characters of each key, so many that a similar key has one of them among its own.

    A text with n pieces, of which a similar one has at least m, shares one of its n - m + 1
    rarest: any order does that all keys are sorted in. Only for lengths that ``q`` serves.
    """
    share, size = (least + 0.5) / 200, F.col("_size")
    others = F.sequence(F.ceil(size * share / (1 - share) - 1e-6).cast("int"), F.floor(size * (1 - share) / share + 1e-6).cast("int"))
    served = F.filter(others, lambda n: piece_length(size, n, least) == q)
    least_of_all = F.array_min(F.transform(served, lambda n: least_common(size, n, least, q)))
    pieces = F.transform(F.sequence(F.lit(1), size - (q - 1)), lambda i: F.substring(F.col(c), i, F.lit(q)))
    numbered = F.transform("_pieces", lambda x, i: F.concat(x, F.size(F.filter(F.slice("_pieces", 1, i + 1), lambda y: y == x)).cast("string")))
    rows = keys.withColumn("_size", F.length(c)).filter(F.col("_size") >= q).withColumn("_take", size - (q - 1) - least_of_all + 1).filter("_take > 0").withColumn("_pieces", pieces)
    rows = rows.select(c, "_size", "_take", F.explode(numbered).alias("_gram")).join(F.broadcast(frequent), "_gram", "left")
    grams = rows.groupBy(c, "_size", "_take").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_gram").alias("g")))).alias("_grams"))
    return grams.select(c, "_size", F.lit(q).alias("_q"), F.explode(F.slice("_grams", 1, F.least(F.col("_take"), F.size("_grams")).cast("int"))).alias("_g")).select(c, "_size", "_q", F.col("_g.g").alias("_gram"))


#: So many pieces are counted for the order from rare to frequent; all others stand before them.
FREQUENT = 10_000


def candidate_keys(own: DataFrame, keys: DataFrame, least: int) -> DataFrame:
    """_own, _key of the pairs that ``similar_keys`` compares: a rare piece in common, and lengths that allow it."""
    counted = own.select(F.col("_own").alias("k")).union(keys.select(F.col("_key").alias("k")))
    pieces = lambda q: F.when(F.length("k") >= q, F.transform(F.sequence(F.lit(1), F.length("k") - (q - 1)), lambda i: F.substring(F.col("k"), i, F.lit(q)))).otherwise(F.array().cast("array<string>"))
    grams = counted.select(F.explode(F.concat(pieces(2), pieces(3))).alias("_gram"))
    frequent = grams.groupBy(F.concat("_gram", F.lit("1")).alias("_gram")).agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), "_gram").limit(FREQUENT)
    both = lambda df, c: key_prefixes(df, c, least, frequent, 2).union(key_prefixes(df, c, least, frequent, 3))
    mine, theirs = both(own, "_own").withColumnRenamed("_size", "_a"), both(keys, "_key").withColumnRenamed("_size", "_b")
    a, b = F.col("_a"), F.col("_b")
    fitting = (F.least(a, b) >= F.ceil((least + 0.5) / 200 * (a + b) - 1e-6)) & (F.col("_q") == piece_length(a, b, least))
    return mine.join(theirs, ["_gram", "_q"]).filter(fitting).select("_own", "_key").distinct()


def similar_keys(own: DataFrame, keys: DataFrame, least: int) -> DataFrame:
    """_own, _key, _s of all pairs of ``_own`` and ``_key`` whose similarity exceeds ``least`` (80 or more); nulls and empty texts have none.

    An inverted index over the keys' rarest pieces of three (short keys: two) characters gives the pairs to compare; no similar pair
    is missed (see ``key_prefixes``). The longest common subsequence decides.
    """
    if least < 80:
        raise ValueError("keys are compared by common pieces, which similar ones need not have below 80")
    own, keys = (df.select(c).filter(F.length(c) > 0).distinct() for df, c in ((own, "_own"), (keys, "_key")))
    same = own.join(keys, F.col("_own") == F.col("_key")).withColumn("_s", F.lit(100))
    found = candidate_keys(own, keys, least).filter("_own <> _key").withColumn("_s", similarity(F.col("_own"), F.col("_key")))
    return same.unionByName(found.filter(F.col("_s") > least))


def merge_stances(*sources: DataFrame, member: str = "member") -> DataFrame:
    """Full outer join of stance sources on the member."""
    return reduce(lambda a, b: a.join(b, member, "full"), sources)


def merge_corpus(old: DataFrame, new: DataFrame, key: str = "uid") -> DataFrame:
    """``old`` and the rows of ``new`` whose key it hasn't."""
    return old.unionByName(new.join(old.select(key), key, "left_anti").select(*old.columns))


def new_members(old: DataFrame, new: DataFrame, member: str = "member") -> DataFrame:
    return new.select(member).filter(F.col(member).isNotNull()).distinct().join(old.select(member).distinct(), member, "left_anti")


def latest_versions(files: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The row with the highest version of each key."""
    return first_by(files, keys, F.desc(version))


def distinct_members(rows: DataFrame, member: str = "member", order: list[str] | None = None) -> DataFrame:
    """The first record of each member; blank ids are dropped."""
    rows = rows.filter(F.col(member).isNotNull() & (F.trim(F.col(member).cast("string")) != ""))
    return first_by(rows, [member], *[F.col(c) for c in order or rows.columns])


def flatten_intervals(records: DataFrame, array: str, value: str, member: str = "member") -> DataFrame:
    """member, start, end, value of an array of {start, end, name}."""
    return records.select(member, F.explode(array).alias("i")).select(member, "i.start", "i.end", F.col("i.name").alias(value))


def flatten_posts(records: DataFrame, arrays: list[str], member: str = "member") -> DataFrame:
    """Posts of all kinds in one table: member, kind, start, end, post."""
    kinds = [records.select(member, F.lit(a).alias("kind"), F.explode(a).alias("i")).select(member, "kind", "i.start", "i.end", F.col("i.name").alias("post")) for a in arrays]
    return reduce(DataFrame.unionByName, kinds)


# groups


def with_labels(df: DataFrame, labels: dict[str, Column]) -> DataFrame:
    """A row for each group whose predicate holds: column ``group``; rows in no group are dropped."""
    found = F.filter(F.array(*[F.when(p, F.lit(n)) for n, p in labels.items()]), lambda x: x.isNotNull())
    return df.withColumn("group", F.explode(found))


def group_by_value(df: DataFrame, column: str, values: list[str] | None = None) -> DataFrame:
    """Groups by party, stance or any other value."""
    df = df.filter(F.col(column).isin(values)) if values else df.filter(F.col(column).isNotNull())
    return df.withColumn("group", F.col(column))


def group_by_lean_stance(df: DataFrame, leave: str = "constituency_leave", stance: str = "ref_stance") -> DataFrame:
    """con-<lean>-mp-<stance>, without unknown stances and leans."""
    label = F.concat(F.lit("con-"), lean(F.col(leave)), F.lit("-mp-"), F.col(stance))
    return df.withColumn("group", label).filter(F.col("group").isNotNull() & (F.col(stance) != "unknown"))


def group_by_stance_vote(df: DataFrame, stance: str = "ref_stance", deal: str = "tmay_deal", other: str = "benn_act") -> DataFrame:
    """ref-x-tmay-y for both, and the groups of a stance that voted the same way twice; a row may be in two."""
    labels = {f"ref-{s}-tmay-{v}": (F.col(stance) == s) & (F.col(deal) == v) for s in ("remain", "leave") for v in ("aye", "no")}
    labels |= {f"ref-{s}-tmay-no-benn-{v}": (F.col(stance) == s) & (F.col(deal) == "no") & (F.col(other) == v) for s, v in (("remain", "aye"), ("leave", "no"))}
    return with_labels(df, labels)


def group_by_member_list(df: DataFrame, lists: DataFrame, member: str = "member", rest: str | None = None) -> DataFrame:
    """Groups from a table group, member; ``rest`` names a group for all other rows."""
    joined = df.join(lists.select(F.col("group"), F.col(member)).distinct(), member, "left" if rest else "inner")
    return joined.withColumn("group", F.coalesce("group", F.lit(rest))) if rest else joined


def select_groups(df: DataFrame, predicates: dict[str, str], token_limit: int | None = None, tokens: str = "tokens") -> DataFrame:
    """Groups by SQL predicates; with a limit only texts of that many tokens, cut to it."""
    df = with_labels(df, {n: F.expr(p) for n, p in predicates.items()})
    if token_limit:
        df = df.filter(F.size(tokens) >= token_limit).withColumn(tokens, F.slice(tokens, 1, token_limit))
    return df


def assign_groups(df: DataFrame, kind, **options) -> DataFrame:
    """Groups by name of the kind, or by a function of the DataFrame."""
    kinds = {"party": lambda d: group_by_value(d, "party"), "stance": lambda d: group_by_value(d, "ref_stance", ["leave", "remain"]), "lean-stance": group_by_lean_stance, "stance-vote": group_by_stance_vote, "all": lambda d: d.withColumn("group", F.lit("all"))}
    return (kind if callable(kind) else kinds[kind])(df, **options)


def split_corpus(df: DataFrame, flag: Column) -> DataFrame:
    """``in_subset``: subset and complement in one scan."""
    return df.withColumn("in_subset", F.coalesce(flag, F.lit(False)))


def stratified_sample(files: DataFrame, strata: list[str], key: str, seed: int) -> DataFrame:
    """One row of each stratum, by seeded hash."""
    return first_by(files, strata, F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), F.col(key))
