"""Queries from files to corpus: files are made of the tables, written into the shared folder and read by the operators."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import corpus, counts, statistics
from ..sources import files, tables, transcripts
from .bindings import CONTRIBUTIONS, TOKENS, WORDS, contributions, documents, table, token_texts, windows_sql
from .queries import SIZE, STANCES, STEP, query, rounded, stances, urgent, windowed

# A1, A2, D5: transcript archives. 500 orders a file, 8 files in an inner archive, 2 of those in an outer one.

_PLACED = """placed AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS s, o_orderpriority AS p, o_orderkey // 500 AS n, 'day' || (o_orderkey // 8000) AS archive, DATE '2019-01-01' + CAST((o_orderkey // 8000) % 28 AS INTEGER) AS folder_date FROM orders)"""


def orders(spark, d) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("p"), F.to_date("o_orderdate").alias("date"))


def transcript_xml(o: DataFrame) -> Column:
    """The elements of one order: every fifth has a heading and a topic, every seventeenth is a question.

    Every other heading is one of oral answers, every seventh is of business without debate; some name a department.
    """
    k, c = F.col("k").cast("string"), F.col("c").cast("string")
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    when = lambda n, x: F.when(F.col("k") % n == 0, x).otherwise("")
    member = text('<Member ContinuationText="m', c, '" PimsId="', c, '" xid="x', c, '">m', c, ":</Member>")
    said = text('<hs_Para UID="', k, '">', member, " says <b>", F.col("s"), "</b>\n  aloud.</hs_Para>")
    asked = text('<Question><hs_Para UID="', k, '">', member, "</hs_Para><QuestionText>Why ", k, "?</QuestionText></Question>")
    tag = F.when(F.col("k") % 35 == 0, "hs_2BusinessWODebate").when(F.col("k") % 10 == 0, "hs_3OralAnswers").otherwise("hs_2DebBill")
    heading = when(5, text("<", tag, ">", F.col("p"), "</", tag, "><hs_8Topic>", F.col("s"), "</hs_8Topic>"))
    office = when(25, text("<hs_6bDepartment><DepartmentName>Office\n", F.col("s"), "</DepartmentName></hs_6bDepartment>"))
    more = text(when(3, text('<hs_Para UID="', k, 'b">And more.</hs_Para>')), when(7, text('<hs_brev>"Quoted\n', k, '"</hs_brev>')), when(11, "<hs_brev>not quoted</hs_brev><!-- note -->"), when(13, "<hs_brev>“Quoted” said he.</hs_brev>"))
    return text(heading, office, F.when(F.col("k") % 17 == 0, asked).otherwise(said), more)


def write_transcripts(spark, d) -> str:
    """Nested zip archives of all orders; their folder."""
    o = orders(spark, d)
    file = F.floor(F.col("k") / 500)
    rows = o.select("k", file.alias("n"), transcript_xml(o).alias("xml"))
    one = rows.groupBy("n").agg(F.array_sort(F.collect_list(F.struct("k", "xml"))).alias("x"))
    head, tail = '<r xmlns="u"><System type="Debate"><Fragment><Header><Sitting short-date="2019-01-02"/></Header><Body>', "</Body></Fragment></System></r>"
    one = one.select(F.concat(F.lit("CHAN"), F.col("n").cast("string"), F.lit(".xml")).alias("file"), F.concat(F.lit(head), F.array_join("x.xml", "\n"), F.lit(tail)).alias("content"), F.floor(F.col("n") / 8).alias("inner"))
    packs = one.groupBy(F.floor(F.col("inner") / 2).alias("outer")).agg(F.collect_list(F.struct("inner", "file", "content")).alias("files"))  # 16 files

    def pack(batches):
        import io
        import zipfile

        import pyarrow as pa

        def zipped(members):
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                for name, data in members:
                    z.writestr(name, data)
            return out.getvalue()

        for batch in batches:
            for r in batch.to_pylist():
                inner: dict = {}
                for f in r["files"]:
                    inner.setdefault(f["inner"], []).append((f["file"], f["content"]))
                content = zipped([("read.me", "x"), ("CHANx.xml", "<r/>"), *((f"part{i}.zip", zipped(members)) for i, members in inner.items())])
                date = dt.date(2019, 1, 1) + dt.timedelta(days=r["outer"] % 28)
                yield pa.RecordBatch.from_pylist([{"name": f"{date}/day{r['outer']}.zip", "content": content}])

    folder = files.scratch(spark, "archives")
    files.write_files(packs.mapInArrow(pack, "name string, content binary"), folder)
    return folder


@query(f"""WITH {_PLACED} SELECT DISTINCT archive, folder_date, 'CHAN' || n || '.xml' AS file FROM placed""")
def archive_files(spark, d):
    return transcripts.read_archives(spark, write_transcripts(spark, d)).select("archive", "folder_date", "file")


@query(f"""WITH {_PLACED}, e AS (SELECT n, unnest(CASE WHEN k % 5 = 0 THEN [CASE WHEN k % 35 = 0 THEN 'hs_2BusinessWODebate' WHEN k % 10 = 0 THEN 'hs_3OralAnswers' ELSE 'hs_2DebBill' END, 'hs_8Topic'] ELSE [] END || CASE WHEN k % 25 = 0 THEN ['hs_6bDepartment'] ELSE [] END || [CASE WHEN k % 17 = 0 THEN 'Question' ELSE 'hs_Para' END] || CASE WHEN k % 3 = 0 THEN ['hs_Para'] ELSE [] END
|| CASE WHEN k % 7 = 0 THEN ['hs_brev'] ELSE [] END || CASE WHEN k % 11 = 0 THEN ['hs_brev'] ELSE [] END || CASE WHEN k % 13 = 0 THEN ['hs_brev'] ELSE [] END) AS tag FROM placed) SELECT 'CHAN' || n || '.xml' AS file, tag, count(*) AS n FROM e GROUP BY ALL""")
def transcript_elements(spark, d):
    found = transcripts.parse_transcripts(transcripts.read_archives(spark, write_transcripts(spark, d)))
    return found.groupBy("file", "tag").agg(F.count(F.lit(1)).alias("n"))


# What the order with key k says: ev has its elements in document order, with the state that they leave behind.
_STATE = f"""{_PLACED}, ev AS (SELECT n, k, c, s, p, unnest(CASE WHEN k % 5 = 0 THEN ['heading', 'topic'] ELSE [] END || CASE WHEN k % 25 = 0 THEN ['department'] ELSE [] END || [CASE WHEN k % 17 = 0 THEN 'question' ELSE 'speech' END] || CASE WHEN k % 3 = 0 THEN ['more'] ELSE [] END
  || CASE WHEN k % 7 = 0 THEN ['quote'] ELSE [] END || CASE WHEN k % 13 = 0 THEN ['said'] ELSE [] END) AS e FROM placed),
no AS (SELECT *, k * 8 + CASE e WHEN 'heading' THEN 0 WHEN 'topic' THEN 1 WHEN 'department' THEN 2 WHEN 'question' THEN 3 WHEN 'speech' THEN 3 WHEN 'more' THEN 4 WHEN 'quote' THEN 5 ELSE 6 END AS pos,
  CASE WHEN k % 35 = 0 THEN 'hs_2BusinessWODebate' WHEN k % 10 = 0 THEN 'hs_3OralAnswers' ELSE 'hs_2DebBill' END AS tag FROM ev),
st AS (SELECT *, max(CASE WHEN e = 'heading' THEN pos END) OVER w AS head, max(CASE WHEN e IN ('heading', 'question', 'speech') THEN pos END) OVER w AS begun,
  last_value(CASE WHEN e = 'heading' THEN tag END IGNORE NULLS) OVER w AS section_tag, last_value(CASE WHEN e = 'heading' THEN p END IGNORE NULLS) OVER w AS section, max(CASE WHEN e = 'topic' THEN pos END) OVER w AS topic_at, last_value(CASE WHEN e = 'topic' THEN s END IGNORE NULLS) OVER w AS topic,
  max(CASE WHEN e = 'department' THEN pos END) OVER w AS department_at, last_value(CASE WHEN e = 'department' THEN 'Office ' || s END IGNORE NULLS) OVER w AS department, max(CASE WHEN e = 'question' THEN pos END) OVER w AS asked_at, last_value(CASE WHEN e = 'question' THEN k END IGNORE NULLS) OVER w AS asked
  FROM no WINDOW w AS (PARTITION BY n ORDER BY pos)),
tx AS (SELECT *, CASE e WHEN 'question' THEN 'Why ' || k || '?' WHEN 'speech' THEN ' says aloud.' WHEN 'more' THEN 'And more.' WHEN 'quote' THEN '"Quoted ' || k || '"' WHEN 'said' THEN '“Quoted” said he.' END AS t FROM st WHERE coalesce(section_tag, '') <> 'hs_2BusinessWODebate')"""


@query(f"""WITH {_STATE}, op AS (SELECT n, pos, k, c, e, section, section_tag, CASE WHEN e = 'question' AND topic_at > coalesce(head, -1) THEN topic END AS topic, CASE WHEN e = 'question' AND department_at > coalesce(head, -1) THEN department END AS department,
  CASE WHEN e = 'speech' AND section_tag = 'hs_3OralAnswers' AND asked_at > coalesce(head, -1) THEN CAST(asked AS VARCHAR) END AS question FROM tx WHERE e IN ('question', 'speech')),
more AS (SELECT n, begun, string_agg(t, ' ' ORDER BY pos) AS added FROM tx WHERE e IN ('more', 'quote', 'said') GROUP BY ALL)
SELECT 'CHAN' || op.n || '.xml' AS file, CAST(k AS VARCHAR) AS uid, c AS member_id, 'x' || c AS member_xid, section, section_tag, department, topic, question, CASE WHEN e = 'question' THEN 'question' ELSE 'contribution' END AS type,
  CASE WHEN e = 'question' THEN 'Why ' || k || '?' ELSE ' says aloud.' || coalesce(' ' || added, '') END AS text FROM op LEFT JOIN more ON more.n = op.n AND more.begun = op.pos""")
def archives_to_contributions(spark, d):
    found = transcripts.assemble_contributions(transcripts.parse_transcripts(transcripts.read_archives(spark, write_transcripts(spark, d))))
    return found.select("file", "uid", "member_id", "member_xid", "section", "section_tag", "department", "topic", "question", "type", "text")


# A3 to A13


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS key, CAST(o_orderkey AS VARCHAR) AS uid, o_custkey AS member_id, CAST(NULL AS BIGINT) AS member_mnis, CAST(o_orderdate AS DATE) AS date, o_orderstatus AS topic, CASE WHEN o_orderkey % 2 = 0 THEN 'q' || o_orderkey END AS question FROM orders""")
def debates_json(spark, d):
    o, k = orders(spark, d), F.col("k").cast("string")
    member = F.struct(F.concat(F.lit("m"), F.col("c").cast("string")).alias("member_name"), F.col("c").alias("member_id"), F.lit(None).cast("long").alias("member_mnis"), F.lit("x").alias("member_xid"))
    entry = F.struct(F.lit("contribution").alias("type"), k.alias("uid"), member.alias("member"), F.lit("Hi").alias("text"), F.col("s").alias("topic"), F.date_format("date", "d MMMM yyyy").alias("date"), F.when(F.col("k") % 2 == 0, F.concat(F.lit("q"), k)).alias("question"))
    maps = o.groupBy(F.floor(F.col("k") / 1000).alias("n")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(k.alias("k"), entry.alias("v"))))).alias("content"))
    folder = files.scratch(spark, "debates")
    files.write_files(maps.select(F.concat(F.col("n").cast("string"), F.lit("-CHAN1.xml.json")).alias("name"), "content"), folder)
    return tables.read_debates(spark, folder).select("key", "uid", "member_id", "member_mnis", "date", "topic", "question")


@query(f"""WITH {CONTRIBUTIONS} SELECT uid, date, c_name AS name FROM contrib JOIN customer ON member = c_custkey WHERE strftime(date, '%Y-%m') = '1997-03'""")
def corpus_tables(spark, d):
    """The corpus tables written and read; one month of contributions is one partition."""
    folder = files.scratch(spark, "corpus")
    members = table(spark, d, "customer").select(F.col("c_custkey").alias("pims_id"), F.col("c_name").alias("name"))
    tables.write_corpus({"contributions": contributions(spark, d), "members": members}, folder)
    back = tables.read_corpus(spark, folder, ["contributions", "members"])
    return back["contributions"].filter("month = '1997-03'").join(back["members"], F.col("member") == F.col("pims_id")).select("uid", "date", "name")


_VOTE = "CASE c_nationkey % 4 WHEN 0 THEN 'Aye' WHEN 1 THEN 'No' WHEN 2 THEN 'Teller - Noes' ELSE '' END"


@query(f"""WITH v AS (SELECT c_custkey // 500 AS number, c_custkey, c_name, c_mktsegment, {_VOTE} AS vote FROM customer), t AS (SELECT number, count(*) FILTER (vote = 'Aye') AS ayes, count(*) FILTER (vote LIKE '%No%') AS noes FROM v GROUP BY 1)
SELECT number, DATE '2019-03-01' + CAST(number % 28 AS INTEGER) AS date, 'Motion ' || number || ', amended' AS title, ayes, noes, c_name || ', Jr' AS member, c_mktsegment AS party,
  CASE WHEN vote = 'Aye' THEN 'aye' WHEN vote LIKE '%No%' THEN 'no' ELSE 'did-not-vote' END AS vote FROM v JOIN t USING (number)""")
def division_csv(spark, d):
    vote = F.element_at(F.array(*map(F.lit, ("Aye", "No", "Teller - Noes", ""))), (F.col("c_nationkey") % 4 + 1).cast("int"))
    rows = table(spark, d, "customer").select(F.floor(F.col("c_custkey") / 500).alias("number"), "c_custkey", vote.alias("vote"), F.concat(F.lit('"'), "c_name", F.lit(', Jr",'), "c_mktsegment", F.lit(",North,"), vote, F.lit(",")).alias("line"))
    one = rows.groupBy("number").agg(F.count(F.when(F.col("vote") == "Aye", 1)).alias("ayes"), F.count(F.when(F.col("vote").contains("No"), 1)).alias("noes"), F.array_join(F.array_sort(F.collect_list("line")), "\r\n").alias("lines"))
    n = F.col("number").cast("string")
    date = F.date_format(F.date_add(F.lit(dt.date(2019, 3, 1)), (F.col("number") % 28).cast("int")), "dd/MM/yyyy")
    head = ["Division Number: ", n, ",,,,\r\nDivision Date: ", date, ',,,,\r\n,,,,\r\n"Motion ', n, ', amended",,,,\r\n,,,,\r\nAye Count: ', F.col("ayes").cast("string"), ",,,,\r\nNoes Count: ", F.col("noes").cast("string"), ",,,,\r\n,,,,\r\nVotes,,,,\r\nMember,Party,Constituency,Vote,Proxy Member\r\n"]
    content = F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in head], "lines", F.lit("\r\n"))
    folder = files.scratch(spark, "divisions")
    files.write_files(one.select(F.concat(F.lit("division"), n, F.lit(".csv")).alias("name"), content.alias("content")), folder)
    meta, votes = tables.read_division(spark, folder)
    return meta.join(votes.select("file", "member", "party", T.clean_vote(F.coalesce("vote", F.lit(""))).alias("vote")), "file").drop("file")


@query("""SELECT CAST(o_orderdate AS DATE) AS date, 'order ' || o_orderkey AS event, o_orderpriority AS colour, 0.5 AS transparency FROM orders""")
def key_dates(spark, d):
    folder = files.scratch(spark, "key-dates")
    rows = orders(spark, d).select(F.date_format("date", "dd-MM-yyyy").alias("date"), F.concat(F.lit("order "), F.col("k").cast("string")).alias("event"), F.col("p").alias("colour"), F.lit("0.5").alias("alpha"))
    rows.write.csv(folder, sep="\t", header=True)
    return tables.read_key_dates(spark, folder)


@query("""SELECT c_mktsegment || '-' || (c_custkey // 1000) AS "group", c_custkey AS member FROM customer""")
def member_groups(spark, d):
    named = table(spark, d, "customer").select(F.concat("c_mktsegment", F.lit("-"), F.floor(F.col("c_custkey") / 1000).cast("string")).alias("group"), F.concat(F.col("c_custkey").cast("string"), F.lit(","), "c_name").alias("line"))
    lists = named.groupBy("group").agg(F.array_join(F.collect_list("line"), "\n").alias("lines"))  # 1000 members at most
    folder = files.scratch(spark, "member-groups")
    files.write_files(lists.select(F.concat("group", F.lit(".csv")).alias("name"), F.concat(F.lit("﻿PimsId,Name\n"), "lines").alias("content")), folder)
    return tables.read_member_groups(spark, folder)


@query("""SELECT doc_id AS uid, coalesce(regexp_matches(lower(source), '1'), false) AS in_subset FROM documents""")
def terms_topic(spark, d):
    """Search terms from a file flag the texts: the names of sources with a 1 (a short list, whatever the table's size)."""
    names = table(spark, d, "documents").filter(F.col("source").contains("1")).agg(F.to_json(F.array_sort(F.collect_set("source"))).alias("value"))
    folder = files.scratch(spark, "terms")
    names.write.text(folder)
    terms = tables.read_terms(spark, folder)
    return corpus.split_corpus(documents(spark, d), T.topic_flag(F.col("text"), F.col("section"), [], [f"^{t}$" for t in terms] or ["^$"], "sections")).select("uid", "in_subset")


@query(f"""WITH {TOKENS} SELECT uid, len(tokens) AS n_tokens, md5(array_to_string(list_transform(tokens, lambda t: t || '/' || upper(t) || '/P' || len(t)), ' ')) AS tagged FROM texts""")
def tagged_token_lines(spark, d):
    """Token lines written as JSON and read back."""
    tag = lambda t: F.struct(t.alias("tok"), F.upper(t).alias("lemma"), F.concat(F.lit("P"), F.length(t).cast("string")).alias("pos"))
    folder = files.scratch(spark, "tagged")
    tables.write_tagged(token_texts(spark, d).select("uid", F.transform("tokens", tag).alias("tagged")), folder)
    line = F.array_join(F.transform("tagged", lambda t: F.concat_ws("/", t["tok"], t["lemma"], t["pos"])), " ")
    return tables.read_tagged(spark, folder).select("uid", F.size("tagged").cast("long").alias("n_tokens"), F.md5(line).alias("tagged"))


def _keywords_sql() -> str:
    from .queries import ORACLE_SQL

    return f'SELECT "group", word, lr FROM ({ORACLE_SQL["group_keywords"]})'


@query(_keywords_sql())
def keyword_files(spark, d):
    """Keyword lists of groups written as JSON and read back."""
    common = counts.token_counts(urgent(spark, d)).filter("n > 50").select("word")
    found = rounded(counts.group_keywords(urgent(spark, d), least_lr=0.2, least_count=5).join(common, "word", "left_semi"), "lr").select("group", "word", "lr")
    folder = files.scratch(spark, "keywords")
    tables.write_keywords(found, folder)
    return tables.read_keywords(spark, folder)


@query(f"""WITH {CONTRIBUTIONS}, s AS (SELECT party, CAST(count(*) AS DOUBLE) AS n_rows, CAST(count(DISTINCT member) AS DOUBLE) AS n_members FROM contrib GROUP BY 1)
SELECT x.statistic, max(CASE WHEN party = 'AUTOMOBILE' THEN v END) AS autos, max(CASE WHEN party = 'BUILDING' THEN v END) AS building FROM s, LATERAL (VALUES ('n_rows', n_rows), ('n_members', n_members)) x(statistic, v) GROUP BY 1""")
def stats_csv(spark, d):
    stats = contributions(spark, d).groupBy("party").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("member").alias("n_members"))
    folder = files.scratch(spark, "stats")
    tables.write_stats(stats, "party", folder)
    back = spark.read.csv(folder, header=True)
    return back.select("statistic", F.col("AUTOMOBILE").cast("double").alias("autos"), F.col("BUILDING").cast("double").alias("building"))


@query("""SELECT c_name AS constituency, (c_custkey % 1000) / 10.0 AS constituency_leave FROM customer WHERE c_custkey % 7 <> 0""")
def constituency_leave(spark, d):
    figure = F.when(F.col("c_custkey") % 7 != 0, F.concat(F.format_string("%.1f", F.col("c_custkey") % 1000 / 10), F.lit("%")))
    folder = files.scratch(spark, "leave")
    table(spark, d, "customer").select(F.lit("E1").alias("ONS ID"), F.concat(F.lit(" "), "c_name").alias("Constituency"), figure.alias("LEAVE FIGURE TO USE")).write.csv(folder, header=True)
    return tables.read_constituency_leave(spark, folder)


# B, C1, E, F11, M1: assembly and text functions


@query(f"""WITH {CONTRIBUTIONS}, {STANCES} SELECT uid, member, c_name AS name, date, CASE WHEN date >= DATE '1998-07-01' THEN 'new-' || party ELSE party END AS party, ref_stance, tmay_deal
FROM contrib JOIN customer ON member = c_custkey JOIN s USING (member) WHERE member % 3 <> 0 AND date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'""")
def assembled_corpus(spark, d):
    """Contributions with date, name, party in force and stances; members without stances are dropped."""
    from .queries import intervals

    o = orders(spark, d)
    said = o.select(F.col("k").alias("uid"), F.col("c").alias("member"), F.date_format("date", "'d'yyyyMMdd").alias("debate"))
    debates = o.select("date").distinct().select(F.date_format("date", "'d'yyyyMMdd").alias("uid"), "date")
    members = table(spark, d, "customer").select(F.col("c_custkey").alias("pims_id"), F.col("c_name").alias("name"), F.lit(None).cast("string").alias("display_name"))
    found = corpus.build_corpus(said, members, debates, intervals(spark, d).withColumnRenamed("member", "pims_id"), stances(spark, d).filter("member % 3 <> 0").withColumnRenamed("member", "pims_id"), dt.date(1996, 1, 1), dt.date(1999, 12, 31))
    return found.select("uid", "member", "name", "date", "party", "ref_stance", "tmay_deal")


@query("""SELECT doc_id AS uid, doc_id % 97 AS member FROM documents WHERE doc_id % 97 NOT IN (3, 5) AND length(text) > 0""")
def members_left_out(spark, d):
    return corpus.drop_empty(corpus.drop_members(documents(spark, d), [3, 5])).select("uid", "member")


@query("""SELECT 'CHAN' || o_orderkey || '-' || strftime(o_orderdate, '%Y-%m-%d') || '.xml' AS file FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-02-01' AND DATE '1997-01-31'""")
def files_in_period(spark, d):
    names = orders(spark, d).select(F.concat(F.lit("CHAN"), F.col("k").cast("string"), F.lit("-"), F.date_format("date", "yyyy-MM-dd"), F.lit(".xml")).alias("file"))
    return corpus.drop_outdated(names, dt.date(1996, 2, 1), dt.date(1997, 1, 31))


@query("""SELECT lang AS "group", count(*) AS n, 'party' AS kind FROM documents WHERE lang IS NOT NULL GROUP BY 1 UNION ALL SELECT source, count(*), 'section' FROM documents WHERE source IN ('src1', 'src2') GROUP BY 1 UNION ALL SELECT 'all', count(*), 'all' FROM documents""")
def groups_by_value(spark, d):
    docs = documents(spark, d)
    kinds = {"party": corpus.assign_groups(docs, "party"), "section": corpus.group_by_value(docs, "section", ["src1", "src2"]), "all": corpus.assign_groups(docs, "all")}
    one, two, three = (df.groupBy("group").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit(k)) for k, df in kinds.items())
    return one.unionByName(two).unionByName(three)


@query("""SELECT o_orderkey AS uid, CAST(o_orderdate AS DATE) AS date, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(NULL AS DATE) AS wrong FROM orders""")
def parsed_dates(spark, d):
    o = orders(spark, d)
    kind = F.element_at(F.array(*map(F.lit, T.DATE_FORMATS)), (F.col("k") % len(T.DATE_FORMATS) + 1).cast("int"))
    written = F.coalesce(*[F.when(kind == k, F.date_format("date", f)) for k, f in T.DATE_FORMATS.items()])
    parsed = F.coalesce(*[F.when(kind == k, T.parse_date(written, k)) for k in T.DATE_FORMATS])
    return o.select(F.col("k").alias("uid"), parsed.alias("date"), T.month_floor(parsed).alias("month"), T.parse_date(F.concat(F.lit("x"), written)).alias("wrong"))


@query("""SELECT o_orderkey AS uid, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey END AS id, CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey END AS number FROM orders""")
def debate_file_names(spark, d):
    k, c = F.col("k").cast("string"), F.col("c").cast("string")
    name = F.concat(F.when(F.col("k") % 3 != 0, k).otherwise("no"), F.lit("-CHAN"), c, F.lit(".xml"))
    return orders(spark, d).select(F.col("k").alias("uid"), T.debate_file_parts(name).alias("p")).select("uid", "p.id", "p.number")


@query(f"""WITH {TOKENS}, g AS (SELECT party, unnest(list_transform(range(1, len(tokens) - 1), lambda i: array_to_string(tokens[i : i + 2], ' '))) AS ngram FROM texts WHERE len(tokens) >= 3) SELECT party, ngram, count(*) AS n FROM g GROUP BY ALL""")
def token_trigrams(spark, d):
    return token_texts(spark, d).select("party", F.explode(T.ngrams(F.col("tokens"), 3)).alias("ngram")).groupBy("party", "ngram").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT c_custkey AS member, CASE WHEN c_nationkey * 4.0 < 50 THEN 'Remain (' || printf('%.1f', 100 - c_nationkey * 4.0) ELSE 'Leave (' || printf('%.1f', c_nationkey * 4.0) END || '%)' AS label FROM customer""")
def lean_labels(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("member"), T.lean_label(F.col("c_nationkey") * 4.0).alias("label"))


@query("""SELECT c_custkey AS member, CASE WHEN i = 0 THEN DATE '1990-01-01' ELSE DATE '1998-07-01' END AS start, CASE WHEN i = 0 THEN DATE '1998-07-01' END AS "end", CASE WHEN i = 0 THEN c_mktsegment ELSE 'new-' || c_mktsegment END AS party FROM customer, range(2) t(i)""")
def member_intervals(spark, d):
    c = table(spark, d, "customer")
    first, second = F.lit(dt.date(1990, 1, 1)), F.lit(dt.date(1998, 7, 1))
    entries = F.array(F.struct(first.alias("start"), second.alias("end"), F.col("c_mktsegment").alias("name")), F.struct(second.alias("start"), F.lit(None).cast("date").alias("end"), F.concat(F.lit("new-"), "c_mktsegment").alias("name")))
    return corpus.flatten_intervals(c.select(F.col("c_custkey").alias("member"), entries.alias("parties")), "parties", "party")


@query(f"""WITH {TOKENS}, {windows_sql("texts", SIZE, STEP)}, ww AS (SELECT window_no, party, unnest(tokens) AS word FROM placed WHERE party IN ('AUTOMOBILE', 'BUILDING')), c AS (SELECT party, window_no, word, count(*) AS n FROM ww GROUP BY ALL), v AS (SELECT *, n / sum(n) OVER (PARTITION BY party, window_no) AS value FROM c)
SELECT coalesce(x.window_no, y.window_no) AS window_no, coalesce(x.word, y.word) AS word, round(coalesce(x.value, 0), 6) AS a, round(coalesce(y.value, 0), 6) AS b FROM (SELECT * FROM v WHERE party = 'AUTOMOBILE') x FULL JOIN (SELECT * FROM v WHERE party = 'BUILDING') y ON x.window_no = y.window_no AND x.word = y.word""")
def aligned_groups(spark, d):
    """Two groups' word shares by window over the union of their cells."""
    rows = counts.token_counts(windowed(spark, d), ["group", "window_no"]).withColumnRenamed("n", "value")
    shares = counts.normalise(rows, ["group", "window_no"])
    return rounded(counts.align(*(shares.filter(F.col("group") == g) for g in ("AUTOMOBILE", "BUILDING"))), "a", "b")
