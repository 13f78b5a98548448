"""Queries over the driver's tables, one or more for each operator, each with its SQL where SQL can express it."""

from __future__ import annotations

import datetime as dt
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import clusters, collocates, corpus, counts, models, sampling, significance, statistics, vectors, windows
from .bindings import CONTRIBUTIONS, TOKENS, WORDS, contributions, documents, table, token_texts, windows_sql

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
#: Search terms of the topic queries.
MENTIONS, SECTIONS = [r"(^|[^a-z])the([^a-z]|$)", r"(^|[^a-z])und([^a-z]|$)"], ["src1", "^src7$"]
SIZE, STEP = 4000, 2000


def query(sql: str | None = None, also: str | None = None):
    """Registers a query with its SQL; ``also`` is another name of the same query."""

    def register(f):
        for name in filter(None, (f.__name__, also)):
            QUERIES[name] = f
            if sql:
                ORACLE_SQL[name] = sql.strip()
        return f

    return register


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, F.round(c, 6))
    return df


# C, D6, D7, B1, B13: assembly


def intervals(spark, d) -> DataFrame:
    """Each customer's time in two intervals at the middle of 1998, the second one open."""
    c = table(spark, d, "customer")
    rows = F.array(
        F.struct(F.lit(dt.date(1990, 1, 1)).alias("start"), F.lit(dt.date(1998, 7, 1)).alias("end"), F.col("c_mktsegment").alias("party")),
        F.struct(F.lit(dt.date(1998, 7, 1)).alias("start"), F.lit(None).cast("date").alias("end"), F.concat(F.lit("new-"), F.col("c_mktsegment")).alias("party")),
    )
    return c.select(F.col("c_custkey").alias("member"), F.explode(rows).alias("i")).select("member", "i.*")


@query(f"""WITH {CONTRIBUTIONS} SELECT uid, member, date, CASE WHEN date >= DATE '1998-07-01' THEN 'new-' || party ELSE party END AS party
FROM contrib WHERE date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'""")
def corpus_party_at_date(spark, d):
    rows = corpus.in_period(contributions(spark, d).drop("party"), dt.date(1996, 1, 1), dt.date(1999, 12, 31))
    return corpus.party_at(rows, intervals(spark, d)).select("uid", "member", "date", "party")


@query("""SELECT c_custkey AS member, 'new-' || c_mktsegment AS party FROM customer""")
def constituency_at_date(spark, d):
    return corpus.constituency_at(intervals(spark, d), dt.date(1998, 7, 1), value="party")


@query("""SELECT o_custkey AS member, arg_max(o_orderpriority, (o_orderdate, o_orderkey, o_orderpriority)) AS constituency FROM orders GROUP BY 1""")
def latest_constituency(spark, d):
    h = table(spark, d, "orders").select(F.col("o_custkey").alias("member"), F.struct("o_orderdate", "o_orderkey").alias("start"), F.col("o_orderpriority").alias("constituency"))
    return corpus.latest_constituency(h)


@query("""SELECT o_orderkey AS uid, o_custkey AS member FROM orders WHERE NOT (o_orderkey % 7 = 0 AND o_custkey % 3 = 0 AND o_custkey % 5 = 0)""")
def member_resolution(spark, d):
    o = table(spark, d, "orders")
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("pims_id"), (F.col("c_custkey") + 1_000_000).alias("mnis_id"), (F.col("c_custkey") + 2_000_000).alias("clerks_id"))
    lost, k = F.col("o_orderkey") % 7 == 0, F.col("o_custkey")
    rows = o.select(F.col("o_orderkey").alias("uid"), F.when(lost, -1).otherwise(k).cast("long").alias("member"), F.when(lost & (k % 3 != 0), k + 1_000_000).alias("mnis_id"), F.when(lost & (k % 5 != 0), k + 2_000_000).alias("clerks_id"))
    return corpus.resolve_members(rows, c).select("uid", "member")


@query("""WITH a AS (SELECT c_custkey AS member, CASE WHEN c_mktsegment = 'BUILDING' THEN 'aye' WHEN c_mktsegment = 'MACHINERY' THEN 'no' ELSE 'did-not-vote' END AS tmay_deal FROM customer WHERE c_custkey % 2 = 0),
b AS (SELECT s_suppkey AS member, CASE WHEN s_acctbal < 0 THEN 'leave' ELSE 'remain' END AS ref_stance FROM supplier),
c AS (SELECT c_custkey AS member, CASE WHEN c_nationkey * 4.0 < 50 THEN 'remain' ELSE 'leave' END AS lean FROM customer WHERE c_custkey % 3 = 0)
SELECT coalesce(a.member, b.member, c.member) AS member, tmay_deal, ref_stance, lean FROM a FULL JOIN b ON a.member = b.member FULL JOIN c ON c.member = coalesce(a.member, b.member)""")
def stance_full_merge(spark, d):
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    vote = F.when(F.col("c_mktsegment") == "BUILDING", "Teller - Ayes").when(F.col("c_mktsegment") == "MACHINERY", "No").otherwise("")
    a = c.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("member"), T.clean_vote(vote).alias("tmay_deal"))
    b = s.select(F.col("s_suppkey").alias("member"), T.clean_stance(F.when(F.col("s_acctbal") < 0, "Leave").otherwise(" Remain")).alias("ref_stance"))
    e = c.filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("member"), T.lean(F.col("c_nationkey") * 4.0).alias("lean"))
    return corpus.merge_stances(a, b, e)


_SUBSEQUENCE = """len(a) - bit_count(list_reduce(list_prepend(CAST((1::HUGEINT << len(a)) - 1 AS HUGEINT), list_transform(string_split(b, ''), lambda c: list_sum(list_transform(range(len(a)), lambda i: CASE WHEN a[i + 1] = c THEN 1::HUGEINT << i::INTEGER ELSE 0 END))::HUGEINT)), lambda r, m: ((r + (r & m)) | (r - (r & m))) & ((1::HUGEINT << len(a)) - 1)))"""


def _similar_sql(pairs: str) -> str:
    return f"(SELECT a, b, round_even(200.0 * ({_SUBSEQUENCE}) / (len(a) + len(b)), 0) AS s FROM {pairs})"


_SPELT = """k AS (SELECT p_name AS name, min(p_partkey) AS found, arg_min(p_type, p_partkey) AS kind FROM part GROUP BY 1),
v AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN replace(p_name, 'a', 'e') WHEN p_partkey % 3 = 0 THEN 'Q' || substr(p_name, 2) ELSE p_name END AS name, CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE p_type END AS kind FROM part)"""
_BEST = f"""p AS (SELECT DISTINCT lower(v.name) AS a, lower(k.name) AS b FROM (SELECT * FROM v WHERE name NOT IN (SELECT name FROM k)) v, k), best AS (SELECT * FROM {_similar_sql("p")} QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) = 1)"""


def spelt_parts(spark, d) -> tuple[DataFrame, DataFrame]:
    """Part names with a letter changed, the first one among them, and the names that they came from; the type stands for a person's name."""
    p = table(spark, d, "part")
    key = F.col("p_partkey")
    name = F.when(key % 2 == 0, F.replace("p_name", F.lit("a"), F.lit("e"))).when(key % 3 == 0, F.concat(F.lit("Q"), F.substring("p_name", 2, 1000))).otherwise(F.col("p_name"))
    spelt = p.select("p_partkey", name.alias("name"), F.when(key % 5 == 0, "").when(key % 5 > 1, F.col("p_type")).alias("kind"))
    return spelt, p.groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("found"), F.min_by("p_type", "p_partkey").alias("kind"))


@query(f"""WITH {_SPELT}, {_BEST} SELECT p_partkey, v.name, found FROM v JOIN k ON v.name = k.name UNION ALL SELECT p_partkey, v.name, found FROM v JOIN best ON lower(v.name) = a JOIN k ON lower(k.name) = b WHERE v.name NOT IN (SELECT name FROM k) AND s > 85""")
def fuzzy_match(spark, d):
    spelt, right = spelt_parts(spark, d)
    return corpus.match_fuzzy(spelt.drop("kind"), right, "name", "found")


@query(f"""WITH {_SPELT}, {_BEST}, n AS (SELECT DISTINCT lower(v.kind) AS a, lower(k.kind) AS b FROM v, k WHERE v.kind <> ''), names AS {_similar_sql("n")}
SELECT p_partkey, v.name, v.kind, found FROM v JOIN k ON v.name = k.name UNION ALL
SELECT p_partkey, v.name, v.kind, found FROM v JOIN best ON lower(v.name) = best.a JOIN k ON lower(k.name) = best.b LEFT JOIN names ON names.a = lower(v.kind) AND names.b = lower(k.kind)
WHERE v.name NOT IN (SELECT name FROM k) AND CASE WHEN coalesce(v.kind, '') = '' THEN best.s > 95 ELSE best.s > 85 AND names.s > 50 END""")
def fuzzy_match_named(spark, d):
    """Similar keys are judged by a second name too; without one they must be more similar."""
    return corpus.match_fuzzy(*spelt_parts(spark, d), "name", "found", "kind")


@query("""SELECT o_orderkey AS uid, o_custkey AS member, CASE WHEN o_orderkey % 3 <> 0 THEN 'old' ELSE 'new' END AS version FROM orders""")
def corpus_update_anti(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("uid"), F.col("o_custkey").alias("member"))
    return corpus.merge_corpus(o.filter("uid % 3 <> 0").withColumn("version", F.lit("old")), o.filter("uid % 2 = 0 or uid % 3 = 0").withColumn("version", F.lit("new")))


@query("""SELECT DISTINCT o_custkey AS member FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01')""")
def new_member_list(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("member"), "o_orderdate")
    cut = F.lit("1996-01-01").cast("timestamp")
    return corpus.new_members(o.filter(F.col("o_orderdate") < cut), o.filter(F.col("o_orderdate") >= cut))


@query("""SELECT l_partkey, l_suppkey, max(l_orderkey * 1000 + l_linenumber) AS version FROM lineitem GROUP BY 1, 2""")
def latest_version(spark, d):
    rows = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", (F.col("l_orderkey") * 1000 + F.col("l_linenumber")).alias("version"))
    return corpus.latest_versions(rows, ["l_partkey", "l_suppkey"], "version")


@query("""SELECT l_orderkey AS uid, l_linenumber, min(l_partkey * 100000 + l_suppkey) AS code FROM lineitem GROUP BY 1, 2""")
def first_per_key(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("uid"), "l_linenumber", (F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("code"))
    return corpus.first_by(rows, ["uid", "l_linenumber"], F.col("code"))


@query("""SELECT o_orderkey AS uid, o_custkey AS member FROM orders WHERE o_custkey % 11 <> 0 AND length(o_orderpriority) > 1 AND o_orderstatus <> 'P'""")
def valid_contributions(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("uid"), F.when(F.col("o_custkey") % 11 != 0, F.col("o_custkey")).alias("member"), F.col("o_orderpriority").alias("text"), F.when(F.col("o_orderstatus") == "P", "hs_2BusinessWODebate").otherwise("hs_8Question").alias("section_tag"))
    return corpus.valid_contributions(o, ["member"]).select("uid", "member")


@query("""SELECT o_custkey AS member, min(o_orderkey) AS uid FROM orders GROUP BY 1""")
def distinct_members(spark, d):
    return corpus.distinct_members(table(spark, d, "orders").select(F.col("o_custkey").alias("member"), F.col("o_orderkey").alias("uid")), order=["uid"])


@query("""SELECT c_custkey AS member, 'past' AS kind, c_mktsegment AS post, c_nationkey AS start FROM customer
UNION ALL SELECT c_custkey, 'present', 'chair', c_nationkey + 1 FROM customer WHERE c_custkey % 2 = 0""")
def flatten_histories(spark, d):
    entry = lambda s, n: F.struct(s.alias("start"), F.lit(None).cast("int").alias("end"), n.alias("name"))
    c = table(spark, d, "customer")
    chair = F.when(F.col("c_custkey") % 2 == 0, F.array(entry(F.col("c_nationkey") + 1, F.lit("chair"))))
    rows = c.select(F.col("c_custkey").alias("member"), F.array(entry(F.col("c_nationkey"), F.col("c_mktsegment"))).alias("past"), chair.alias("present"))
    return corpus.flatten_posts(rows, ["past", "present"]).select("member", "kind", "post", "start")


# B: groups and topics


@query(r"""SELECT doc_id AS uid, coalesce(regexp_matches(lower(text), '(?:(^|[^a-z])the([^a-z]|$))|(?:(^|[^a-z])und([^a-z]|$))'), false) AS in_subset FROM documents""")
def topic_split(spark, d):
    return corpus.split_corpus(documents(spark, d), T.topic_flag(F.col("text"), F.col("section"), MENTIONS, SECTIONS, "mentions")).select("uid", "in_subset")


@query("""SELECT doc_id AS uid, coalesce(regexp_matches(lower(source), '(?:src1)|(?:^src7$)'), false) AS in_subset FROM documents""")
def topic_split_sections(spark, d):
    return corpus.split_corpus(documents(spark, d), T.topic_flag(F.col("text"), F.col("section"), MENTIONS, SECTIONS, "sections")).select("uid", "in_subset")


STANCES = """s AS (SELECT c_custkey AS member, CASE WHEN c_acctbal < 0 THEN 'leave' WHEN c_acctbal < 5000 THEN 'remain' ELSE 'unknown' END AS ref_stance, c_nationkey * 4.0 AS constituency_leave,
  CASE WHEN c_nationkey % 3 = 0 THEN 'aye' WHEN c_nationkey % 3 = 1 THEN 'no' ELSE 'did-not-vote' END AS tmay_deal, CASE WHEN c_nationkey % 2 = 0 THEN 'aye' ELSE 'no' END AS benn_act FROM customer)"""


def stances(spark, d) -> DataFrame:
    n = F.col("c_nationkey")
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("member"), F.when(F.col("c_acctbal") < 0, "leave").when(F.col("c_acctbal") < 5000, "remain").otherwise("unknown").alias("ref_stance"), (n * 4.0).alias("constituency_leave"),
        F.when(n % 3 == 0, "aye").when(n % 3 == 1, "no").otherwise("did-not-vote").alias("tmay_deal"), F.when(n % 2 == 0, "aye").otherwise("no").alias("benn_act"),
    )


@query(f"""WITH {STANCES} SELECT member, 'con-' || CASE WHEN constituency_leave < 50 THEN 'remain' ELSE 'leave' END || '-mp-' || ref_stance AS "group" FROM s WHERE ref_stance <> 'unknown'""")
def groups_lean_stance(spark, d):
    return corpus.group_by_lean_stance(stances(spark, d)).select("member", "group")


@query(f"""WITH {STANCES} SELECT member, 'ref-' || ref_stance || '-tmay-' || tmay_deal AS "group" FROM s WHERE ref_stance <> 'unknown' AND tmay_deal <> 'did-not-vote'
UNION ALL SELECT member, 'ref-' || ref_stance || '-tmay-no-benn-' || benn_act FROM s WHERE tmay_deal = 'no' AND ((ref_stance = 'remain' AND benn_act = 'aye') OR (ref_stance = 'leave' AND benn_act = 'no'))""")
def groups_stance_vote(spark, d):
    return corpus.group_by_stance_vote(stances(spark, d)).select("member", "group")


@query("""SELECT o_orderkey AS uid, CASE WHEN o_custkey % 10 = 1 THEN 'ones' ELSE 'other' END AS "group" FROM orders WHERE o_custkey % 10 <> 2
UNION ALL SELECT o_orderkey, g FROM orders, (VALUES ('twos'), ('both')) t(g) WHERE o_custkey % 10 = 2""")
def groups_by_list(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("member"))
    named = lambda n, k: c.filter(F.col("member") % 10 == k).withColumn("group", F.lit(n))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("uid"), F.col("o_custkey").alias("member"))
    return corpus.group_by_member_list(o, named("ones", 1).unionByName(named("twos", 2)).unionByName(named("both", 2)), rest="other").select("uid", "group")


@query(f"""WITH {TOKENS} SELECT uid, g AS "group", array_to_string(tokens[1:3], ' ') AS text FROM texts, (VALUES ('autos'), ('low')) t(g) WHERE len(tokens) >= 3 AND ((g = 'autos' AND party = 'AUTOMOBILE') OR (g = 'low' AND con < 12))""")
def select_groups_min_tokens(spark, d):
    found = corpus.select_groups(token_texts(spark, d), {"autos": "party = 'AUTOMOBILE'", "low": "con < 12"}, token_limit=3)
    return found.select("uid", "group", F.array_join("tokens", " ").alias("text"))


# E: text




def _decomposed_sql(text: str) -> str:
    """Compatibility decomposition of the lower-case Latin-1 letters; tests hold other characters against fixed values."""
    for c in map(chr, range(0xE0, 0x100)):
        if (d := unicodedata.normalize("NFKD", c)) != c:
            text = f"replace({text}, '{c}', '{d}')"
    return text


_CLEAN = r"""regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(lower(text), '^\s+|\s+$', '', 'g'), '\p{Nd}+(\.\p{Nd}+)*', 'NUMBER', 'g'), chr(10), ' '), '([.,!?:;]+)([\p{L}\p{N}_])', '\1 \2', 'g'), ' +', ' ', 'g')"""
_CLEANED = f"SELECT doc_id AS uid, {_decomposed_sql(_CLEAN)} AS t FROM documents"


@query(f"SELECT uid, md5(t) AS cleaned FROM ({_CLEANED})", also="clean_text_all")
def clean_text(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("uid"), F.md5(T.clean_text(F.col("text"))).alias("cleaned"))


@query(rf"""SELECT uid, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens FROM (SELECT uid, regexp_extract_all(regexp_replace(t, '(\p{{P}})\p{{P}}*', '\1 ', 'g'), '[\p{{L}}\p{{M}}\p{{N}}_]+-?|[^\s\p{{L}}\p{{M}}\p{{N}}_]') AS t FROM ({_CLEANED}))""", also="tokenise_all")
def tokenise(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("uid"), T.tokenise(F.col("text")).alias("t"))
    return rows.select("uid", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens"))


@query("""SELECT member, name, position(' ' IN name) = 0 AS single FROM (SELECT s_suppkey AS member, CASE s_suppkey % 5 WHEN 1 THEN 'Dr. ' WHEN 2 THEN 'Lady ' WHEN 4 THEN 'Rt Hon ' ELSE '' END || s_name AS name FROM supplier)""")
def display_name(spark, d):
    titles = F.array(*map(F.lit, ("Mr ", "Dr. ", "Baroness Lady ", "", "Rt Hon ")))
    s = table(spark, d, "supplier").withColumn("n", F.concat(F.element_at(titles, (F.col("s_suppkey") % 5 + 1).cast("int")), F.col("s_name")))
    return s.select(F.col("s_suppkey").alias("member"), T.display_name(F.col("n")).alias("name"), T.is_single_word(T.display_name(F.col("n"))).alias("single"))


@query(f"""WITH {TOKENS} SELECT uid, CAST(i AS INTEGER) AS chunk_no, array_to_string(tokens[i * 3 + 1 : i * 3 + 3], ' ') AS chunk FROM texts, range(100) t(i) WHERE len(tokens) > 3 AND i < ceil((len(tokens) - 3) / 3)""")
def token_chunks(spark, d):
    return windows.make_chunks(token_texts(spark, d), 3).select("uid", "chunk_no", F.array_join("tokens", " ").alias("chunk"))


@query(f"""WITH {TOKENS}, p AS (SELECT party, list_zip(list_prepend(chr(2), tokens), list_append(tokens, chr(2))) AS b FROM texts), e AS (SELECT party, unnest(b) AS b FROM p)
SELECT party, b[1] AS w1, b[2] AS w2, count(*) AS n FROM e GROUP BY ALL""")
def padded_bigrams(spark, d):
    return models.train_bigrams(token_texts(spark, d), ["party"])


# D: windows


@query("""WITH c AS (SELECT conv_id, turn, role, text, last_value(CASE WHEN role = 'system' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS context,
  role <> 'system' AND lag(role) OVER (PARTITION BY conv_id ORDER BY turn) = role AS same FROM conversations),
i AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM c)
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY island) - 1 AS INTEGER) AS turn_no, any_value(role) AS role, md5(coalesce(any_value(context), '')) AS context, count(*) AS n_turns, md5(string_agg(text, ' ' ORDER BY turn)) AS text
FROM i WHERE role <> 'system' GROUP BY conv_id, island""")
def conversation_merge(spark, d):
    t = table(spark, d, "conversations")
    m = windows.merge_turns(t, "conv_id", "turn", "role", "text", F.col("role") == "system")
    return m.select("conv_id", "turn_no", "role", F.md5(F.coalesce("context", F.lit(""))).alias("context"), "n_turns", F.md5("text").alias("text"))


@query(f"""WITH {CONTRIBUTIONS}, b AS (SELECT min(date) AS a, max(date) AS z FROM contrib),
w AS (SELECT i AS window_no, a + CAST(i * 180 AS INTEGER) AS s, a + CAST(i * 180 + 364 AS INTEGER) AS e FROM b, range(1000) t(i) WHERE i * 180 < (z - a) - 365)
SELECT CAST(window_no AS BIGINT) AS window_no, s AS window_start, e AS window_end, count(*) AS n_rows FROM w JOIN contrib ON date BETWEEN s AND e GROUP BY ALL""")
def time_windows(spark, d):
    w = windows.time_windows(contributions(spark, d), 365, 180)
    return w.groupBy("window_no", "window_start", "window_end").agg(F.count(F.lit(1)).alias("n_rows"))


@query(f"""WITH {CONTRIBUTIONS}, {windows_sql("contrib", SIZE, STEP)} SELECT window_no, window_start, count(*) AS n_rows, CAST(sum(uid) AS BIGINT) AS uids FROM placed GROUP BY ALL""")
def contribution_windows(spark, d):
    w = windows.contribution_windows(contributions(spark, d), SIZE, STEP)
    return w.groupBy("window_no", "window_start").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("uid").alias("uids"))


@query(f"""WITH {CONTRIBUTIONS}, {windows_sql("contrib", SIZE, STEP)} SELECT window_no, min(date) AS first_date, max(date) AS last_date, count(*) AS n_rows FROM placed GROUP BY ALL""")
def window_spans(spark, d):
    return windows.window_spans(windows.contribution_windows(contributions(spark, d), SIZE, STEP))


@query(f"""WITH {CONTRIBUTIONS}, {windows_sql("contrib", SIZE, STEP)} SELECT window_no, count(*) AS n_rows FROM placed WHERE section = '1-URGENT' GROUP BY ALL""")
def windowed_subset(spark, d):
    rows = corpus.split_corpus(contributions(spark, d), F.col("section") == "1-URGENT")
    return windows.windowed_subset(rows, SIZE, STEP).groupBy("window_no").agg(F.count(F.lit(1)).alias("n_rows"))


@query(f"""WITH {CONTRIBUTIONS}, g AS (SELECT party, date, count(*) AS n_rows, count(*) AS n_words FROM contrib GROUP BY ALL)
SELECT party, date, n_rows, n_words, CAST(sum(n_rows) OVER w AS BIGINT) AS rows_so_far, CAST(sum(n_words) OVER w AS BIGINT) AS words_so_far FROM g WINDOW w AS (PARTITION BY party ORDER BY date)""")
def cumulative_contribs(spark, d):
    return windows.cumulative(contributions(spark, d), ["party"], F.lit(1))


@query(f"""WITH {CONTRIBUTIONS}, g AS (SELECT party, date, count(*) AS n_rows FROM contrib GROUP BY ALL)
SELECT party, date, n_rows, CAST(sum(n_rows) OVER (PARTITION BY party ORDER BY date RANGE BETWEEN INTERVAL 364 DAYS PRECEDING AND CURRENT ROW) AS BIGINT) AS total FROM g""")
def rolling_365(spark, d):
    return windows.rolling_total(contributions(spark, d), 365, ["party"])


@query(f"""WITH {CONTRIBUTIONS}, {windows_sql("contrib", SIZE, STEP)} SELECT window_no, party, count(*) AS n_rows FROM placed GROUP BY ALL""")
def window_group_sizes(spark, d):
    return windows.window_sizes(windows.contribution_windows(contributions(spark, d), SIZE, STEP), ["party"])


@query(f"""WITH {CONTRIBUTIONS}, {windows_sql("contrib", SIZE, STEP)}, m AS (SELECT window_no, member, count(*) AS n FROM placed GROUP BY ALL) SELECT window_no, CAST(quantile_cont(n, 0.5) AS DOUBLE) AS median_rows FROM m GROUP BY ALL""")
def median_per_member(spark, d):
    return windows.median_per_member(windows.contribution_windows(contributions(spark, d), SIZE, STEP))


_SNAPS = """starts AS (SELECT CAST(i AS BIGINT) AS window_no, DATE '1995-06-01' + CAST(i * 200 AS INTEGER) AS window_start FROM range(8) t(i))"""


def snapshots(spark) -> DataFrame:
    return spark.range(8).select(F.col("id").alias("window_no"), F.date_add(F.lit(dt.date(1995, 6, 1)), (F.col("id") * 200).cast("int")).alias("window_start"))


@query(f"""WITH {CONTRIBUTIONS}, {_SNAPS} SELECT uid, max(window_no) AS snapshot_no FROM contrib JOIN starts ON date >= window_start GROUP BY uid""")
def snapshot_asof(spark, d):
    return windows.snapshot_for(contributions(spark, d), snapshots(spark)).select("uid", "snapshot_no")


@query(f"""WITH {CONTRIBUTIONS}, {_SNAPS} SELECT uid, max(window_no) - 1 AS snapshot_no FROM contrib JOIN starts ON date >= window_start GROUP BY uid HAVING max(window_no) > 0""")
def snapshot_asof_previous(spark, d):
    return windows.snapshot_for(contributions(spark, d), snapshots(spark), previous=True).select("uid", "snapshot_no")


@query("""SELECT event_id, n_nationkey AS span FROM events JOIN nation ON event_id % 1000 > n_nationkey * 30 AND event_id % 1000 < n_nationkey * 30 + 20""")
def events_in_windows(spark, d):
    spans = table(spark, d, "nation").select(F.col("n_nationkey").alias("span"), (F.col("n_nationkey") * 30).alias("beg"), (F.col("n_nationkey") * 30 + 20).alias("end"))
    return windows.events_in_windows(table(spark, d, "events").select("event_id", (F.col("event_id") % 1000).alias("date")), spans).select("event_id", "span")


# F: statistics


@query(f"""WITH {TOKENS}, r AS (SELECT party, count(*) AS n_rows, CAST(sum(len(tokens)) AS BIGINT) AS n_words, CAST(quantile_cont(len(tokens), 0.5) AS DOUBLE) AS median_words, round(avg(len(tokens)), 6) AS mean_words FROM texts GROUP BY 1),
m AS (SELECT party, member, count(*) AS r, sum(len(tokens)) AS s FROM texts GROUP BY 1, 2)
SELECT r.*, n_members, n_active, median_member_words, mean_member_words, median_member_rows, mean_member_rows FROM r JOIN (SELECT party, count(*) AS n_members, count(*) FILTER (r > 15) AS n_active, CAST(quantile_cont(s, 0.5) AS DOUBLE) AS median_member_words,
  round(avg(s), 6) AS mean_member_words, CAST(quantile_cont(r, 0.5) AS DOUBLE) AS median_member_rows, round(avg(r), 6) AS mean_member_rows FROM m GROUP BY 1) USING (party)""")
def corpus_stats(spark, d):
    s = statistics.corpus_stats(token_texts(spark, d), ["party"], active=15)
    return rounded(s, "mean_words", "mean_member_words", "mean_member_rows")


@query(f"""WITH {CONTRIBUTIONS} SELECT party, section, count(*) AS n_rows, count(*) AS n_words, count(DISTINCT member) AS n_members FROM contrib GROUP BY CUBE (party, section)""")
def stats_cube(spark, d):
    return statistics.stats_cube(contributions(spark, d), ["party", "section"], F.lit(1))


@query(f"""WITH {CONTRIBUTIONS}, q AS (SELECT q AS quantile, (SELECT quantile_cont(price, 0.5) FROM contrib) AS value FROM (VALUES (0.5)) t(q) UNION ALL SELECT 0.95, (SELECT quantile_cont(price, 0.95) FROM contrib))
SELECT CAST(quantile AS DOUBLE) AS quantile, round(value, 6) AS value, round(sum(price) FILTER (price > value), 2) AS sum_above, round(sum(price) FILTER (price <= value), 2) AS sum_below, count(DISTINCT member) FILTER (price > value) AS members_above, count(DISTINCT member) FILTER (price <= value) AS members_below
FROM contrib, q GROUP BY quantile, value""")
def quantile_split(spark, d):
    s = statistics.quantile_split(contributions(spark, d), "price", [0.5, 0.95])
    return rounded(s, "value").withColumn("sum_above", F.round("sum_above", 2)).withColumn("sum_below", F.round("sum_below", 2))


@query("""WITH s AS (SELECT min(n_chars) AS a, max(n_chars) AS z FROM documents)
SELECT CAST(least(floor((n_chars - a) / ((z - a) / 30.0)), 29) AS INTEGER) AS bin, count(*) AS n FROM documents, s GROUP BY 1""")
def histogram_linear(spark, d):
    return statistics.histogram(table(spark, d, "documents"), "n_chars").select("bin", "n")


@query("""WITH s AS (SELECT ln(min(o_totalprice)) AS a, ln(max(o_totalprice)) AS z FROM orders)
SELECT CAST(least(floor((ln(o_totalprice) - a) / ((z - a) / 30)), 29) AS INTEGER) AS bin, count(*) AS n FROM orders, s GROUP BY 1""")
def histogram_log(spark, d):
    return statistics.histogram(table(spark, d, "orders"), "o_totalprice", log=True).select("bin", "n")


@query(f"""WITH {CONTRIBUTIONS} SELECT member, count(*) AS n_rows, count(*) AS n_words, any_value(party) AS party FROM contrib GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50""")
def top_members(spark, d):
    return statistics.top_members(contributions(spark, d), 50, F.lit(1))


@query("""SELECT DISTINCT lang AS section, source AS section_tag FROM documents""")
def distinct_sections(spark, d):
    return statistics.distinct_sections(table(spark, d, "documents").select(F.col("lang").alias("section"), F.col("source").alias("section_tag")))


# F: keywords


@query(f"""WITH {WORDS} SELECT party, word, count(*) AS n FROM words GROUP BY ALL""")
def token_counts(spark, d):
    return counts.token_counts(token_texts(spark, d), ["party"])


@query(f"""WITH {WORDS} SELECT word, count(*) AS n FROM words GROUP BY 1 ORDER BY n DESC, word LIMIT 20""")
def top_tokens(spark, d):
    return counts.top_tokens(token_texts(spark, d), 20)


def _paired(by: str, target: str, source: str = "words", extra: str = "") -> str:
    """cnt (by, word, c1, c2, n1, n2) in SQL."""
    keys = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    return f"""cnt AS (SELECT *, sum(c1) OVER ({part}) AS n1, sum(c2) OVER ({part}) AS n2 FROM (SELECT {keys}word, count(*) FILTER ({target}) AS c1, count(*) FILTER (NOT ({target})) AS c2 FROM {source} {extra} GROUP BY ALL))"""


_LR = "log2((c1 + 0.5) / n1) - log2((c2 + 0.5) / n2)"
_LL = "2 * (CASE WHEN c1 > 0 THEN c1 * ln(c1 * (n1 + n2) / (n1 * (c1 + c2))) ELSE 0 END + CASE WHEN c2 > 0 THEN c2 * ln(c2 * (n1 + n2) / (n2 * (c1 + c2))) ELSE 0 END)"
_URGENT = "section = '1-URGENT'"


def urgent(spark, d) -> DataFrame:
    return token_texts(spark, d).withColumn("group", F.col("party")).withColumn("in_subset", F.col("section") == "1-URGENT")


@query(f"""WITH {WORDS}, {_paired("", _URGENT)} SELECT word, c1, c2, round({_LR}, 6) AS lr FROM cnt""")
def log_ratio(spark, d):
    return rounded(counts.log_ratio(token_texts(spark, d), F.col("section") == "1-URGENT"), "lr")


@query(f"""WITH {WORDS}, {_paired("", _URGENT)} SELECT word, c1, c2, round({_LR}, 6) AS lr FROM cnt WHERE c1 > 10 AND {_LR} > 0.1""")
def keywords(spark, d):
    return rounded(counts.keywords(token_texts(spark, d), F.col("section") == "1-URGENT", least_lr=0.1), "lr")


@query(f"""WITH {WORDS}, {_paired("", _URGENT)} SELECT word, c1, c2, round({_LR}, 6) AS lr, round({_LL}, 6) AS ll FROM cnt""")
def keyness_ll(spark, d):
    return rounded(counts.keyness(token_texts(spark, d), F.col("section") == "1-URGENT"), "lr", "ll")


@query(f"""WITH {WORDS}, {_paired("party", _URGENT)}, freq AS (SELECT word FROM words GROUP BY 1 HAVING count(*) > 50) SELECT party AS "group", word, c1, c2, round({_LR}, 6) AS lr FROM cnt WHERE c1 > 5 AND {_LR} > 0.2 AND word IN (SELECT word FROM freq)""")
def group_keywords(spark, d):
    rows = urgent(spark, d)
    common = counts.token_counts(rows).filter("n > 50").select("word")
    return rounded(counts.group_keywords(rows, least_lr=0.2, least_count=5).join(common, "word", "left_semi"), "lr")


@query(f"""WITH {WORDS}, {_paired("", _URGENT)} SELECT word, round({_LR}, 6) AS lr, round({_LL}, 6) AS ll FROM cnt WHERE {_LR} > 0.05 AND c1 + c2 > 100""")
def keyword_vocabulary(spark, d):
    return rounded(counts.keyword_vocabulary(urgent(spark, d), least_lr=0.05), "lr", "ll")


def windowed(spark, d) -> windows.PlacedRows:
    return windows.placed_rows(urgent(spark, d), SIZE, STEP)


_WINDOWED = f"""{TOKENS}, {windows_sql("texts", SIZE, STEP)}, ww AS (SELECT window_no, party, section, unnest(tokens) AS word FROM placed)"""


@query(f"""WITH {_WINDOWED}, top AS (SELECT unnest(tokens) AS word FROM texts), t20 AS (SELECT word FROM top GROUP BY 1 ORDER BY count(*) DESC, word LIMIT 20), c AS (SELECT party, window_no, word, count(*) AS n FROM ww GROUP BY ALL), s AS (SELECT *, sum(n) OVER (PARTITION BY party, window_no) AS total FROM c)
SELECT party AS "group", window_no, word, n, round(n / total, 6) AS value FROM s WHERE word IN (SELECT word FROM t20)""")
def window_word_freq(spark, d):
    return rounded(counts.word_frequencies(windowed(spark, d), counts.top_tokens(token_texts(spark, d), 20)), "value")


@query(f"""WITH {_WINDOWED} SELECT party AS "group", window_no, word, count(*) AS n FROM ww GROUP BY ALL""")
def window_block_counts(spark, d):
    rows = windows.row_positions(urgent(spark, d))
    return counts.block_counts(rows, SIZE, STEP, ["group"])


@query(f"""WITH {_WINDOWED}, {_paired("party, window_no", _URGENT, "ww")} SELECT party AS "group", window_no, word, c1 AS value, round({_LR}, 6) AS lr FROM cnt WHERE c1 > 2 AND {_LR} > 0.5""")
def window_keywords(spark, d):
    return rounded(counts.window_keywords(windowed(spark, d), least_lr=0.5, least_count=2), "lr")


def _shared_sql(value: str) -> str:
    return f"""WITH {_WINDOWED}, {_paired("party, window_no", _URGENT, "ww")}, ev AS (SELECT *, sum(c1) OVER (PARTITION BY window_no) AS n1, sum(c2) OVER (PARTITION BY window_no) AS n2 FROM (SELECT window_no, word, sum(c1) AS c1, sum(c2) AS c2 FROM cnt GROUP BY ALL)),
sh AS (SELECT window_no, word FROM ev WHERE c1 > 10 AND {_LR} > 0.3) SELECT party AS "group", window_no, word, round({value}, 6) AS value FROM cnt JOIN sh USING (window_no, word) WHERE c1 > 0"""


@query(_shared_sql("c1 / n1"))
def window_keywords_shared(spark, d):
    return rounded(counts.window_keywords_shared(windowed(spark, d), least_lr=0.3), "value")


@query(_shared_sql(f"CASE WHEN {_LR} > 0.3 THEN c1 / n1 ELSE 0 END"))
def window_keywords_own(spark, d):
    return rounded(counts.window_keywords_shared(windowed(spark, d), least_lr=0.3, own_only=True), "value")


_SPECS = {"autos_early": ("party = 'AUTOMOBILE' and date < '1998-07-01'", "party <> 'AUTOMOBILE' and date < '1998-07-01'"), "autos_change": ("party = 'AUTOMOBILE' and date >= '1998-07-01'", "party = 'AUTOMOBILE' and date < '1998-07-01'")}


def _spec_sql() -> str:
    parts = [f"SELECT '{n}' AS spec, word, count(*) FILTER ({t}) AS c1, count(*) FILTER ({r}) AS c2 FROM words WHERE ({t}) OR ({r}) GROUP BY word" for n, (t, r) in _SPECS.items()]
    return f"WITH {WORDS}, u AS ({' UNION ALL '.join(parts)}), cnt AS (SELECT *, sum(c1) OVER (PARTITION BY spec) AS n1, sum(c2) OVER (PARTITION BY spec) AS n2 FROM u) SELECT spec, word, c1, c2, round({_LR}, 6) AS lr FROM cnt WHERE c1 > 10 AND {_LR} > 0.05"


@query(_spec_sql())
def period_keywords(spark, d):
    return rounded(counts.period_keywords(token_texts(spark, d), _SPECS, least_lr=0.05), "lr")


@query(f"""WITH {WORDS}, {_paired("", _URGENT)}, a AS (SELECT word, {_LR} AS lr FROM cnt), {_paired("", "section = '5-LOW'").replace("cnt AS", "cnt2 AS")}, b AS (SELECT word, {_LR} AS lr FROM cnt2),
x AS (SELECT word, lr, row_number() OVER (ORDER BY lr DESC, word) AS r FROM a WHERE lr > 0.05), y AS (SELECT word, lr, row_number() OVER (ORDER BY lr DESC, word) AS r FROM b WHERE lr > 0.05)
SELECT word, round(x.lr - y.lr, 6) AS lr_diff FROM x JOIN y USING (word)""")
def keyword_rank_diff(spark, d):
    of = lambda s: counts.keywords(token_texts(spark, d), F.col("section") == s, least_lr=0.05, least_count=-1)
    return rounded(counts.compare_keywords(of("1-URGENT"), of("5-LOW")).select("word", "lr_diff"), "lr_diff")


@query(f"""WITH {_WINDOWED}, t AS (SELECT word, count(*) AS n FROM ww GROUP BY 1 ORDER BY n DESC, word LIMIT 40), c AS (SELECT party, window_no, word, count(*) AS n FROM ww GROUP BY ALL), s AS (SELECT *, sum(n) OVER (PARTITION BY party, window_no) AS total FROM c)
SELECT party AS "group", window_no, word, round(n / total, 6) AS value FROM s WHERE word IN (SELECT word FROM t)""")
def bow_features(spark, d):
    return rounded(counts.bow_features(windowed(spark, d), top=40), "value")


@query(f"""WITH {_WINDOWED}, c AS (SELECT party AS "group", window_no // 3 AS cluster, word, count(*) AS c1 FROM ww GROUP BY ALL),
k AS (SELECT *, sum(c1) OVER (PARTITION BY "group", word) AS w, sum(c1) OVER (PARTITION BY "group", cluster) AS n1, sum(c1) OVER (PARTITION BY "group") AS g FROM c), z AS (SELECT *, w - c1 AS c2, g - n1 AS n2 FROM k)
SELECT "group", cluster, word, c1, CAST(c2 AS BIGINT) AS c2, round({_LR}, 6) AS lr FROM z WHERE n2 > 0 AND c1 > 20 AND w > 20 AND {_LR} > 0.1""")
def cluster_keywords(spark, d):
    rows = counts.token_counts(windowed(spark, d), ["group", "window_no"]).groupBy("group", F.floor(F.col("window_no") / 3).alias("cluster"), "word").agg(F.sum("n").alias("n"))
    return rounded(counts.cluster_keywords(rows, 20, 20, 0.1), "lr")


@query(f"""WITH {_WINDOWED}, {_paired("party, window_no", _URGENT, "ww")} SELECT party AS "group", window_no, count(*) AS n_features FROM cnt WHERE c1 > 2 AND {_LR} > 0.5 GROUP BY ALL""")
def features_per_window(spark, d):
    return counts.features_per_window(counts.window_keywords(windowed(spark, d), least_lr=0.5, least_count=2))
