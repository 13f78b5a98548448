"""Windows over time and rows, chunks, running totals, as-of joins, transcript state."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .statistics import grouped_quantiles


def window_numbers(position: Column, size: int, step: int, total: Column) -> Column:
    """The windows that hold a position: start at multiples of ``step``, below ``total - size``."""
    last = F.least(F.floor(position / step), F.floor((total - size - 1) / step))
    first = F.greatest(F.ceil((position - size + 1) / step), F.lit(0))
    return F.when((total > size) & (first <= last), F.sequence(first.cast("long"), last.cast("long"))).otherwise(F.array().cast("array<bigint>"))


def time_windows(df: DataFrame, size: int, step: int, date: str = "date") -> DataFrame:
    """A row for each day window that holds it: window_no, window_start, window_end (both ends included).

    Windows start every ``step`` days from the first date and are ``size`` days long;
    none starts ``size`` days or less before the last date. Only the least and the
    greatest date are gathered.
    """
    span = df.agg(F.min(date).alias("_first"), F.max(date).alias("_last"))  # one row
    offset, total = F.datediff(date, "_first"), F.datediff("_last", "_first")
    wide = df.crossJoin(F.broadcast(span)).withColumn("window_no", F.explode(window_numbers(offset, size, step, total)))
    start = F.date_add("_first", (F.col("window_no") * step).cast("int"))
    return wide.withColumn("window_start", start).withColumn("window_end", F.date_add(start, size - 1)).drop("_first", "_last")


def row_positions(df: DataFrame, date: str = "date", uid: str = "uid", part_rows: int = 100_000) -> DataFrame:
    """``position``: place in the order (date, uid), from 0, and ``_total``; rows that repeat a date and uid come in any order.

    Days with at most ``part_rows`` rows are parts of the order as they are; those with more are
    cut at ids that are taken from the data (approximate percentiles of the day's different
    ids), however they cluster. Rows are numbered inside a part, and what stands before it is a
    running sum over days and over a day's parts; no task sorts more than a part, unless so
    many rows repeat one id. Rows without a date or uid have no place and are left out.
    """
    rows = df.filter(F.col(date).isNotNull() & F.col(uid).isNotNull())
    days = rows.groupBy(F.col(date).alias("_d")).agg(F.count(F.lit(1)).alias("_rows"))
    # a row a day: as many as the calendar has
    order = Window.orderBy("_d")
    days = days.withColumn("_upto", F.sum("_rows").over(order)).withColumn("_total", F.sum("_rows").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    large = days.filter(F.col("_rows") > part_rows).select("_d", "_rows")
    most = large.agg(F.max("_rows")).first()[0] or 0
    pieces = max(1, -(-2 * most // part_rows))
    days = days.withColumn("_cuts", F.array().cast(f"array<{dict(df.dtypes)[uid]}>"))
    if pieces > 1:
        ids = rows.select(F.col(date).alias("_d"), F.col(uid).alias("_u")).join(F.broadcast(large.select("_d")), "_d")  # no more days than the calendar has
        shares = [i / pieces for i in range(1, pieces)]
        cuts = ids.groupBy("_d").agg(F.percentile_approx("_u", F.lit(shares), max(10_000, 20 * pieces)).alias("_found"))
        days = days.join(cuts, "_d", "left").withColumn("_cuts", F.coalesce(F.array_sort(F.array_distinct("_found")), "_cuts")).drop("_found")
    placed = rows.join(F.broadcast(days.select("_d", (F.col("_upto") - F.col("_rows")).alias("_day_before"), "_total", "_cuts")), F.col(date) == F.col("_d"))
    placed = placed.withColumn("_part", F.size(F.filter("_cuts", lambda c: c < F.col(uid)))).drop("_cuts", "_d")
    sizes = placed.groupBy(F.col(date).alias("_d"), F.col("_part").alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.groupBy("_d").agg(F.collect_list(F.struct("_p", "_n")).alias("_sizes"))  # as many as a day has parts
    before = F.aggregate(F.filter("_sizes", lambda s: s["_p"] < F.col("_part")), F.lit(0).cast("long"), lambda n, s: n + s["_n"])
    numbered = placed.withColumn("_within", F.row_number().over(Window.partitionBy(date, "_part").orderBy(uid)) - 1)
    joined = numbered.join(sizes, F.col(date) == F.col("_d"))
    return joined.withColumn("position", F.col("_day_before") + before + F.col("_within")).drop("_d", "_part", "_sizes", "_day_before", "_within")


def contribution_windows(df: DataFrame, size: int, step: int, date: str = "date", uid: str = "uid") -> DataFrame:
    """A row for each window of ``size`` rows that holds it, every ``step`` rows in the order (date, uid).

    Keyed by ``window_no``; ``window_start`` is the first date in the window. No window starts at
    the number of rows less ``size`` or later.
    """
    rows = row_positions(df, date, uid).withColumn("window_no", F.explode(window_numbers(F.col("position"), size, step, F.col("_total")))).drop("_total")
    starts = rows.groupBy("window_no").agg(F.min(date).alias("window_start"))
    return rows.drop("position").join(starts, "window_no")


@dataclass(frozen=True)
class PlacedRows:
    """Rows with their place (``position`` of ``_total``: rows or days) and the overlapping windows over them.

    What takes windowed rows and counts in them (``counts.token_counts``, ``paired_counts``,
    ``collocates``) takes these instead: everything is counted once, not once a window.
    """

    rows: DataFrame
    size: int
    step: int

    def blocks(self) -> DataFrame:
        """Rows with their block of the common divisor of size and step, and the number of windows."""
        return self.rows.withColumn("_block", F.floor(F.col("position") / math.gcd(self.size, self.step))).withColumn("_windows", F.greatest(F.ceil((F.col("_total") - self.size) / self.step), F.lit(0)))

    def sums(self, counts: DataFrame, by: list[str], values: list[str]) -> DataFrame:
        """Counts of blocks (by, _block, _windows, values) as counts of windows: by, window_no, values; no rows of zeros.

        A block's count enters at the first window that has it and leaves after the last: two
        changes, however much windows overlap. Running sums of the changes are the windows' counts,
        and stay the same up to the next change.
        """
        unit = math.gcd(self.size, self.step)
        wide, stride = self.size // unit, self.step // unit
        first = F.greatest(F.ceil((F.col("_block") - wide + 1) / stride), F.lit(0))
        change = lambda at, sign: F.struct(at.cast("long").alias("window_no"), *[(F.col(v) * sign).alias(v) for v in values])
        changes = counts.select(*by, "_windows", F.inline(F.array(change(first, 1), change(F.floor(F.col("_block") / stride) + 1, -1)))).filter("window_no < _windows")
        order = Window.partitionBy(*by).orderBy("window_no")
        running = changes.select(*by, "_windows", "window_no", F.lead("window_no").over(order).alias("_next"), *[F.sum(v).over(order.rangeBetween(Window.unboundedPreceding, 0)).alias(v) for v in values])
        some = reduce(lambda a, b: a | b, (F.col(v) != 0 for v in values))
        runs = running.filter(F.coalesce(F.col("_next") > F.col("window_no"), F.lit(True)) & some)
        return runs.withColumn("window_no", F.explode(F.sequence("window_no", F.coalesce("_next", "_windows") - 1))).select(*by, "window_no", *values)


def placed_rows(df: DataFrame, size: int, step: int, date: str = "date", uid: str = "uid") -> PlacedRows:
    """``contribution_windows`` without a row for each window."""
    return PlacedRows(row_positions(df, date, uid), size, step)


def placed_days(df: DataFrame, size: int, step: int, date: str = "date") -> PlacedRows:
    """``time_windows`` without a row for each window."""
    span = df.agg(F.min(date).alias("_first"), F.max(date).alias("_last"))  # one row
    rows = df.crossJoin(F.broadcast(span)).withColumn("position", F.datediff(date, "_first")).withColumn("_total", F.datediff("_last", "_first"))
    return PlacedRows(rows.drop("_first", "_last"), size, step)


def window_spans(windowed: DataFrame, date: str = "date") -> DataFrame:
    return windowed.groupBy("window_no").agg(F.min(date).alias("first_date"), F.max(date).alias("last_date"), F.count(F.lit(1)).alias("n_rows"))


def windowed_subset(df: DataFrame, size: int, step: int, flag: str = "in_subset", **options) -> DataFrame:
    """Rows of the subset in windows that are defined on all rows."""
    return contribution_windows(df, size, step, **options).filter(flag)


def window_sizes(windowed: DataFrame, by: list[str]) -> DataFrame:
    return windowed.groupBy("window_no", *by).agg(F.count(F.lit(1)).alias("n_rows"))


def median_per_member(windowed: DataFrame, member: str = "member") -> DataFrame:
    """The median number of rows a member has in each window."""
    per_member = windowed.groupBy("window_no", member).agg(F.count(F.lit(1)).alias("_n"))
    return grouped_quantiles(per_member, ["window_no"], "_n", [0.5]).select("window_no", F.col("value").alias("median_rows"))


def cumulative(df: DataFrame, by: list[str], words: Column, date: str = "date") -> DataFrame:
    """Rows and words a day, and so far, for each slice."""
    daily = df.groupBy(*by, date).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(words).alias("n_words"))
    order = Window.partitionBy(*by).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    return daily.withColumn("rows_so_far", F.sum("n_rows").over(order)).withColumn("words_so_far", F.sum("n_words").over(order))


def rolling_total(df: DataFrame, days: int, by: list[str], date: str = "date") -> DataFrame:
    """Rows of the last ``days`` days, the day included, for each day with rows."""
    daily = df.groupBy(*by, date).agg(F.count(F.lit(1)).alias("n_rows")).withColumn("_day", F.unix_date(date))
    return daily.withColumn("total", F.sum("n_rows").over(Window.partitionBy(*by).orderBy("_day").rangeBetween(-(days - 1), 0))).drop("_day")


def make_chunks(df: DataFrame, size: int, tokens: str = "tokens") -> DataFrame:
    """Chunks of ``size`` tokens: chunk_no and the chunk as ``tokens``; the last full or partial chunk of a text is dropped."""
    n = F.size(tokens)
    starts = F.when(n > size, F.sequence(F.lit(0), F.ceil((n - size) / size).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    chunks = F.transform(starts, lambda i: F.slice(F.col(tokens), i * size + 1, size))
    columns = [c for c in df.columns if c != tokens]
    return df.select(*columns, F.posexplode(chunks).alias("chunk_no", tokens))


def snapshot_for(texts: DataFrame, starts: DataFrame, previous: bool = False, date: str = "date") -> DataFrame:
    """The snapshot in force at a text's date, [start, next start), or the one before it.

    As-of join: each start's row is an interval to the next start; intervals don't overlap, so a text has at most one.
    Texts meet the intervals of their month.
    """
    order = Window.orderBy("window_start")  # a row for each snapshot, of which there are at most as many as days
    spans = starts.select("window_no", "window_start").distinct()
    spans = spans.withColumn("_until", F.lead("window_start").over(order)).withColumn("_before", F.lag("window_no").over(order))
    last = texts.agg(F.max(date)).first()[0]
    month = lambda c: F.trunc(c, "month")
    end = F.greatest(F.coalesce(F.date_sub("_until", 1), F.lit(last)), F.col("window_start"))
    spans = spans.withColumn("_month", F.explode(F.sequence(month("window_start"), month(end), F.expr("interval 1 month"))))
    inside = (F.col(date) >= F.col("window_start")) & (F.col("_until").isNull() | (F.col(date) < F.col("_until")))
    joined = texts.join(spans, (month(date) == F.col("_month")) & inside)
    joined = joined.withColumn("snapshot_no", F.col("_before" if previous else "window_no"))
    return joined.filter(F.col("snapshot_no").isNotNull()).drop("_until", "_before", "_month", "window_no", "window_start")


def events_in_windows(events: DataFrame, spans: DataFrame, date: str = "date") -> DataFrame:
    """Events strictly inside intervals (beg, end) of dates or numbers.

    Intervals are cut at steps of their mean length, so there are about three pieces each,
    and events meet the pieces of their step.
    """
    number = lambda df, c: F.unix_date(c) if dict(df.dtypes)[c] == "date" else F.col(c)
    low, high, at = number(spans, "beg"), number(spans, "end"), number(events, date)
    step = spans.agg(F.avg(F.when(high > low, high - low))).first()[0] or 1
    pieces = spans.filter(high > low).withColumn("_step", F.explode(F.sequence(F.floor(low / step), F.floor(high / step))))
    joined = events.withColumn("_at", F.floor(at / step)).join(pieces, F.col("_at") == F.col("_step"))
    return joined.filter((F.col("beg") < F.col(date)) & (F.col(date) < F.col("end"))).drop("_at", "_step")


def merge_turns(turns: DataFrame, file: str, position: str, speaker: str, text: str, marker: Column, separator: str = " ") -> DataFrame:
    """Consecutive turns of one speaker merged, each with the last marker text before it carried forward.

    Result: file, turn_no (from 0), speaker, context, n_turns, text. Marker rows reset the
    state and are no turns. Within a file the order is ``position``.
    """
    order = Window.partitionBy(file).orderBy(position)
    rows = turns.withColumn("_context", F.last(F.when(marker, F.col(text)), ignorenulls=True).over(order)).withColumn("_marker", marker)
    new = F.col("_marker") | (F.lag("_marker", 1, True).over(order)) | ~F.lag(speaker).over(order).eqNullSafe(F.col(speaker))
    rows = rows.withColumn("_island", F.sum(new.cast("int")).over(order)).filter("not _marker")
    merged = rows.groupBy(file, "_island").agg(F.first(speaker).alias(speaker), F.first("_context").alias("context"), F.count(F.lit(1)).alias("n_turns"), F.array_sort(F.collect_list(F.struct(position, text))).alias("_parts"))
    number = F.row_number().over(Window.partitionBy(file).orderBy("_island")) - 1
    joined = F.array_join(F.transform("_parts", lambda p: p[text]), separator)
    return merged.select(file, number.alias("turn_no"), speaker, "context", "n_turns", joined.alias(text))
