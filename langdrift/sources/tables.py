"""Corpus tables, votes, key dates, member lists, terms, tagged tokens and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Schemas of the corpus tables.
SCHEMAS = {
    "contributions": "uid long, member long, debate string, body string, is_question boolean, referring_to long, topic string, section string, cont_type string, section_tag string, department string",
    "debates": "uid string, date date, number int, file string",
    "members": "pims_id long, mnis_id long, clerks_id long, name string, curr_party string, curr_constituency string, member_since date, member_until date, display_name string",
    "member_party": "pims_id long, start date, end date, party string",
    "member_constituency": "pims_id long, start date, end date, constituency string",
    "member_post": "uid long, pims_id long, start date, end date, post string",
    "member_stances": "pims_id long, tmay_deal string, benn_act string, ref_stance string, constituency_leave double",
}
DEBATE = "map<string, struct<type: string, uid: string, member: struct<member_name: string, member_id: long, member_mnis: long, member_xid: string>, contribution_type: string, text: string, topic: string, department: string, section: string, section_tag: string, date: string, hansard_file: string, question: string>>"


def write_corpus(tables: dict[str, DataFrame], path: str) -> None:
    """Writes the tables as Parquet; contributions with a ``date`` by month."""
    for name, df in tables.items():
        if name == "contributions" and "date" in df.columns:
            df.withColumn("month", F.date_format("date", "yyyy-MM")).write.mode("overwrite").partitionBy("month").parquet(f"{path}/{name}")
        else:
            df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_corpus(spark: SparkSession, path: str, names: list[str] = tuple(SCHEMAS)) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


#: The columns by which the corpus tables of a database are read in parts; all others are read whole.
DATABASE_KEYS = {"contributions": "uid"}


def read_database(spark: SparkSession, url: str, names: list[str] = tuple(SCHEMAS), keys: dict[str, str] = DATABASE_KEYS, partitions: int = 32, predicates: dict[str, list[str]] | None = None, **options) -> dict[str, DataFrame]:
    """The tables of an existing database over JDBC (its driver must be on the class path).

    A table in ``keys`` is read by ``partitions`` connections, each with a range of its key (a
    number, date or timestamp) between the least and the greatest that the database has; null
    keys are in the first. Where keys cluster, ``predicates`` of a table can name its parts
    instead: conditions of which every row meets exactly one.
    """
    read = lambda what, **more: spark.read.format("jdbc").options(url=url, dbtable=what, **options, **more)

    def one(name: str) -> DataFrame:
        if name in (predicates or {}):
            return spark.read.jdbc(url, name, predicates=predicates[name], properties=options)
        if name not in keys:
            return read(name).load()
        low, high = read(f"(SELECT MIN({keys[name]}) AS low, MAX({keys[name]}) AS high FROM {name}) bounds").load().first()
        if low is None or low == high:
            return read(name).load()
        return read(name, partitionColumn=keys[name], lowerBound=str(low), upperBound=str(high), numPartitions=str(partitions)).load()

    return {n: one(n) for n in names}


def read_debates(spark: SparkSession, path: str) -> DataFrame:
    """Contributions in debate JSON files, each a map of uid to contribution: file, key, and its fields."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.from_json("value", DEBATE).alias("m"))
    rows = text.select("file", F.explode("m").alias("key", "c")).select("file", "key", "c.*")
    return rows.select("*", "member.*").drop("member").withColumn("date", F.to_date("date", "d MMMM yyyy"))


def read_constituency_leave(spark: SparkSession, path: str, column: str = "LEAVE FIGURE TO USE") -> DataFrame:
    """constituency, constituency_leave: percent text as a number."""
    rows = spark.read.csv(path, header=True)
    percent = F.regexp_replace(F.trim(F.col(f"`{column}`")), "%", "")
    return rows.select(F.trim("Constituency").alias("constituency"), percent.try_cast("double").alias("constituency_leave")).filter("constituency_leave is not null")


def read_division(spark: SparkSession, path: str, header_line: int = 10) -> tuple[DataFrame, DataFrame]:
    """(meta, votes) of division files: nine lines about the division, then a table.

    meta: file, number, date, title, ayes, noes. votes: file, member, party, constituency, vote, proxy.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.split("value", r"\r?\n").alias("lines"))
    head = F.array_join(F.slice("lines", 1, header_line - 1), "\n")
    field = lambda p: F.nullif(F.trim(F.regexp_extract(head, p, 1)), F.lit(""))
    count = lambda p: F.regexp_replace(field(p), ",", "").cast("long")
    meta = files.select("file", count(r"Division Number: *([0-9]+)").alias("number"), F.to_date(field(r"Division Date: *([0-9/]+)"), "dd/MM/yyyy").alias("date"), F.trim(F.regexp_replace(F.element_at("lines", 4), r"^\"|\"?,*$", "")).alias("title"), count(r"Aye Count: *([0-9]+)").alias("ayes"), count(r"Noe?s Count: *([0-9]+)").alias("noes"))
    row = "member string, party string, constituency string, vote string, proxy string"
    lines = files.select("file", F.posexplode("lines").alias("i", "line")).filter((F.col("i") >= header_line) & (F.trim("line") != ""))
    votes = lines.select("file", F.from_csv("line", F.lit(row)).alias("v")).select("file", "v.*")
    return meta, votes.select("file", *[F.trim(c).alias(c) for c in ("member", "party", "constituency", "vote", "proxy")])


def read_key_dates(spark: SparkSession, path: str) -> DataFrame:
    """date, event, colour, transparency from tab-separated text with dates as dd-MM-yyyy."""
    rows = spark.read.csv(path, sep="\t", header=True, schema="date string, event string, colour string, transparency double")
    return rows.withColumn("date", F.to_date(F.trim("date"), "dd-MM-yyyy"))


def read_member_groups(spark: SparkSession, path: str) -> DataFrame:
    """group, member: the group is the file's name, the member the first column."""
    lines = spark.read.text(path).select(F.regexp_replace(F.col("_metadata.file_name"), r"\.csv$", "").alias("group"), F.regexp_extract("value", r"^[﻿\"]*([0-9]+)", 1).alias("m"))
    return lines.filter("m <> ''").select("group", F.col("m").cast("long").alias("member")).distinct()


def read_terms(spark: SparkSession, path: str) -> list[str]:
    """A JSON array of strings or numbers, as strings."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("t"))
    return [r["t"] for r in rows.collect()]  # a list of search terms or speakers


TAGGED = "array<struct<tok: string, lemma: string, pos: string>>"


def write_tagged(df: DataFrame, path: str, uid: str = "uid", tagged: str = "tagged") -> None:
    """A JSON line [uid, [{tok, lemma, pos}]] for each row."""
    line = F.concat(F.lit("["), F.col(uid).cast("string"), F.lit(", "), F.to_json(tagged), F.lit("]"))
    df.select(line.alias("value")).write.mode("overwrite").text(path)


def read_tagged(spark: SparkSession, path: str) -> DataFrame:
    """uid, tagged of such lines."""
    lines = spark.read.text(path)
    return lines.select(F.get_json_object("value", "$[0]").cast("long").alias("uid"), F.from_json(F.get_json_object("value", "$[1]"), TAGGED).alias("tagged"))


def write_keywords(df: DataFrame, path: str) -> None:
    """{group: {word: lr}} as one JSON object a line and group; columns group, word, lr."""
    words = df.groupBy("group").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("word", "lr")))).alias("words"))
    words.select(F.to_json(F.create_map("group", "words")).alias("value")).write.mode("overwrite").text(path)


def read_keywords(spark: SparkSession, path: str) -> DataFrame:
    """group, word, lr of one object, or of an object a line."""
    maps = spark.read.text(path).select(F.from_json("value", "map<string, map<string, double>>").alias("m"))
    return maps.select(F.explode("m").alias("group", "words")).select("group", F.explode("words").alias("word", "lr"))


def write_results(ce: DataFrame, path: str, params: dict | None = None) -> None:
    """Flat results (run, snap_group, test_group, window_start, uid, ce) as Parquet, with the parameters as columns."""
    for name, value in (params or {}).items():
        ce = ce.withColumn(f"param_{name}", F.lit(value))
    ce.write.mode("overwrite").parquet(path)


def nested_results(ce: DataFrame) -> DataFrame:
    """run and the JSON view {snap_group: {test_group: {window: {uid: ce}}}} of flat results.

    A row holds the texts of one run, pair of groups and window, which sampling bounds;
    readers merge the objects of a run.
    """
    texts = ce.groupBy("run", "snap_group", "test_group", "window_start").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("uid").cast("string").alias("k"), F.col("ce").alias("v"))))).alias("m"))
    nested = F.create_map("snap_group", F.create_map("test_group", F.create_map(F.col("window_start").cast("string"), "m")))
    return texts.select("run", F.to_json(nested).alias("json"))


def read_results(json: DataFrame, column: str = "json") -> DataFrame:
    """Flat rows of ``nested_results``."""
    m = json.select("run", F.from_json(column, "map<string, map<string, map<string, map<string, double>>>>").alias("m"))
    for name in ("snap_group", "test_group", "window_start", "uid"):
        m = m.select(*[c for c in m.columns if c != "m"], F.explode("m").alias(name, "m"))
    return m.withColumnRenamed("m", "ce").withColumn("uid", F.col("uid").cast("long")).withColumn("window_start", F.to_date("window_start"))


def write_stats(stats: DataFrame, slice_column: str, path: str, slices: list[str] | None = None) -> None:
    """A CSV with a row for each statistic and a column for each slice."""
    names = [c for c in stats.columns if c != slice_column]
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("statistic"), F.col(n).cast("double").alias("v")) for n in names]))
    wide = stats.withColumn("s", pairs).groupBy("s.statistic").pivot(slice_column, slices).agg(F.first("s.v"))
    wide.coalesce(1).write.mode("overwrite").csv(path, header=True)
