"""Readers and writers on small files of our own."""

import datetime as dt
import io
import json
import zipfile

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from langdrift.sources import files, tables, transcripts

XML = """<r xmlns="u"><System type="Debate"><Fragment><Header><Sitting short-date="2019-01-02"/></Header><Body>
<hs_2DebBill>Trade</hs_2DebBill><hs_8Topic>Steel</hs_8Topic>
<hs_Para UID="1"><Member ContinuationText="Ann" PimsId="5" xid="x5">Ann:</Member> I rise.</hs_Para><!-- note -->
<hs_Para UID="2">And I stay.</hs_Para><hs_brev>"Quoted."</hs_brev><hs_brev>not quoted</hs_brev>
<hs_Para UID="3"><Member ContinuationText="Bob" PimsId="6">Bob:</Member> No.</hs_Para>
<hs_3OralAnswers>Health</hs_3OralAnswers><hs_6bDepartment><DepartmentName>NHS</DepartmentName></hs_6bDepartment>
<Question><hs_Para UID="4"><Member ContinuationText="Cy" PimsId="7"/></hs_Para><QuestionText>Why so?</QuestionText></Question>
<hs_Para UID="5">Loose words</hs_Para>
</Body></Fragment></System></r>"""


def zipped(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files.items():
            z.writestr(name.replace("__", "."), data)
    return out.getvalue()


def test_nested_archives_to_contributions(spark, tmp_path):
    inner = zipped(CHAN12__xml=XML, CHANx__xml="<r/>", note__txt="x")
    folder = tmp_path / "2019-01-02"
    folder.mkdir()
    (folder / "day.zip").write_bytes(zipped(part__zip=inner, CHAN3__xml="broken <"))
    files = transcripts.read_archives(spark, str(tmp_path))
    assert sorted((r["archive"], r["folder_date"], r["file"]) for r in files.collect()) == [("day", dt.date(2019, 1, 2), "CHAN12.xml"), ("day", dt.date(2019, 1, 2), "CHAN3.xml")]
    found = {r["uid"]: r for r in transcripts.assemble_contributions(transcripts.parse_transcripts(files)).collect()}
    assert set(found) == {"1", "3", "4"}
    assert found["1"]["text"] == ' I rise. And I stay. "Quoted."'
    assert (found["1"]["section"], found["1"]["topic"], found["1"]["member_id"], found["3"]["member_xid"]) == ("Trade", None, 5, None)
    assert (found["4"]["section"], found["4"]["department"], found["4"]["type"]) == ("Health", "NHS", "question")
    assert found["4"]["text"] == "Why so?"


def contributions_of(spark, bodies, after=""):
    """Contributions of a file with a fragment for each body, by uid."""
    fragments = "".join(f'<Fragment><Header><Sitting short-date="2019-01-0{i + 1}"/></Header><Body>{b}</Body></Fragment>' for i, b in enumerate(bodies))
    xml = f'<r xmlns="u"><System type="Debate">{fragments}</System>{after}</r>'
    files = spark.createDataFrame([("a", "CHAN1.xml", xml.encode())], "archive string, file string, content binary")
    return {r["uid"]: r for r in transcripts.assemble_contributions(transcripts.parse_transcripts(files)).collect()}


def says(uid, name, text, **more):
    extra = "".join(f' {k}="{v}"' for k, v in more.items())
    return f'<hs_Para UID="{uid}"><Member ContinuationText="{name}" PimsId="5"{extra}/>{text}</hs_Para>'


def asks(uid, text, inner=""):
    return f'<Question><hs_Para UID="{uid}"><Member ContinuationText="Cy" PimsId="7"/>{inner}</hs_Para>{text}</Question>'


def test_nothing_is_added_to_a_question(spark):
    found = contributions_of(spark, [says(1, "A", "One.") + asks(2, "<QuestionText>Why <i>so</i>\n then?</QuestionText>") + '<hs_Para UID="3">Lost.</hs_Para><hs_brev>"Lost"</hs_brev>' + says(4, "B", "Two.") + '<hs_Para UID="5">Kept.</hs_Para>'])
    assert {k: r["text"] for k, r in found.items()} == {"1": " One.", "2": "Why then?", "4": " Two. Kept."}


def test_questions_without_their_own_text_say_their_paragraph(spark):
    found = contributions_of(spark, [asks(1, "", "If so?") + "<Question><QuestionText>No paragraph?</QuestionText></Question>"])
    assert {k: r["text"] for k, r in found.items()} == {"1": " If so?"}


def test_what_is_carried_and_where_it_stands(spark):
    opening = "<hs_6bDepartment><DepartmentName>Trade\nand Industry</DepartmentName></hs_6bDepartment><hs_8Topic>Steel\nprices</hs_8Topic>"
    body = f"<hs_3OralAnswers>Oral\nAnswers</hs_3OralAnswers>{opening}" + asks(1, "<QuestionText>Why?</QuestionText>") + says(2, "A", "So.") + "<hs_3OralAnswers><b>x</b></hs_3OralAnswers>" + says(3, "A", "Still.")
    body += "<hs_2DebBill>A <i>Bill</i>\n here</hs_2DebBill>" + says(4, "A", "Then.") + asks(5, "<QuestionText>How?</QuestionText>") + says(6, "B", "Thus.")
    found = contributions_of(spark, [body])
    assert {k: (r["section"], r["department"], r["topic"], r["question"]) for k, r in found.items()} == {
        "1": ("Oral Answers", "Trade and Industry", "Steel prices", None), "2": ("Oral Answers", None, None, "1"), "3": ("Oral Answers", None, None, "1"),
        "4": ("A Bill  here", None, None, None), "5": ("A Bill  here", None, None, None), "6": ("A Bill  here", None, None, None),
    }


def test_quotes_begin_with_a_mark_and_hold_another(spark):
    quotes = ['"Whole"', "“Quoted text” said he.", "Said he “no”", '"open', "'single\nline'", '""']
    found = contributions_of(spark, [says(1, "A", "He said") + "".join(f"<hs_brev>{q}</hs_brev>" for q in quotes) + "<hs_brev><i>inner</i></hs_brev>"])
    assert found["1"]["text"] == " He said \"Whole\" “Quoted text” said he. 'single line'"


def test_speech_goes_on_in_the_next_fragment_and_only_the_first_debate_is_read(spark):
    other = f'<System type="Debate"><Fragment><Header/><Body>{says(9, "Z", "Other.")}</Body></Fragment></System>'
    found = contributions_of(spark, ["<hs_2DebBill>S</hs_2DebBill>" + says(1, "A", "One."), '<hs_Para UID="2">More.</hs_Para>' + says(1, "B", "Again.") + says(3, "C", "") + '<hs_2BusinessWODebate>B</hs_2BusinessWODebate>' + says(4, "D", "Unheard.")], other)
    assert {k: (r["text"], r["date"], r["section"], r["member_xid"]) for k, r in found.items()} == {"1": (" One. More.", "2019-01-01", "S", None)}


def test_debates(spark, tmp_path):
    one = {"7": {"type": "contribution", "uid": "7", "member": {"member_name": "Ann", "member_id": 5, "member_mnis": None, "member_xid": "x"}, "text": "Hi", "date": "5 March 2019"}}
    (tmp_path / "1-CHAN2.xml.json").write_text(json.dumps(one))
    r = tables.read_debates(spark, str(tmp_path)).first()
    assert (r["file"], r["uid"], r["member_id"], r["date"], r["question"]) == ("1-CHAN2.xml.json", "7", 5, dt.date(2019, 3, 5), None)


def test_division(spark, tmp_path):
    lines = ["Division Number: 7,,,,", "Division Date: 03/09/2019,,,,", ",,,,", '"A motion, amended",,,,', ",,,,", "Aye Count: 2,,,,", "Noes Count: 1,,,,", ",,,,", "Votes,,,,", "Member,Party,Constituency,Vote,Proxy Member", "Ann Lee,Blue,North,Aye,", '"Bo, Jr",Red,South,Teller - Noes,Cy']
    (tmp_path / "deal.csv").write_text("\r\n".join(lines) + "\r\n")
    meta, votes = tables.read_division(spark, str(tmp_path))
    m = meta.first()
    assert (m["number"], m["date"], m["title"], m["ayes"], m["noes"]) == (7, dt.date(2019, 9, 3), "A motion, amended", 2, 1)
    assert sorted((r["member"], r["vote"], r["proxy"]) for r in votes.collect()) == [("Ann Lee", "Aye", None), ("Bo, Jr", "Teller - Noes", "Cy")]


def test_small_inputs(spark, tmp_path):
    (tmp_path / "d.csv").write_text("date\tevent\tcolour\talpha\n03-09-2019\tVote\tred\t0.5\n")
    assert tables.read_key_dates(spark, str(tmp_path / "d.csv")).first()["date"] == dt.date(2019, 9, 3)
    (tmp_path / "lists").mkdir()
    (tmp_path / "lists" / "erg.csv").write_text("﻿PimsId,Name\n5,Ann\n6,Bob\n")
    assert sorted(map(tuple, tables.read_member_groups(spark, str(tmp_path / "lists")).collect())) == [("erg", 5), ("erg", 6)]
    (tmp_path / "t.json").write_text('["eu", "brexit"]')
    assert tables.read_terms(spark, str(tmp_path / "t.json")) == ["eu", "brexit"]
    (tmp_path / "c.csv").write_text(",ONS ID,Constituency,LEAVE FIGURE TO USE\n1,E1,North,48.9%\n2,E2,South,\n")
    assert [tuple(r) for r in tables.read_constituency_leave(spark, str(tmp_path / "c.csv")).collect()] == [("North", 48.9)]


def test_round_trips(spark, tmp_path):
    tagged = spark.createDataFrame([(1, [("a", "a", "DT")]), (2, [])], f"uid long, tagged {tables.TAGGED}")
    tables.write_tagged(tagged, str(tmp_path / "tagged"))
    assert sorted(tables.read_tagged(spark, str(tmp_path / "tagged")).collect()) == sorted(tagged.collect())
    words = spark.createDataFrame([("g", "a", 1.5), ("g", "b", 2.0), ("h", "a", 1.0)], "group string, word string, lr double")
    tables.write_keywords(words, str(tmp_path / "kw"))
    assert sorted(tables.read_keywords(spark, str(tmp_path / "kw")).collect()) == sorted(words.collect())
    ce = spark.createDataFrame([(0, "a", "b", dt.date(2020, 1, 1), 1, 2.5), (0, "a", "a", dt.date(2020, 1, 1), 2, 1.5), (1, "a", "b", dt.date(2020, 1, 1), 1, 2.0)], "run int, snap_group string, test_group string, window_start date, uid long, ce double")
    back = tables.read_results(tables.nested_results(ce)).select(*ce.columns)
    assert sorted(back.collect()) == sorted(ce.collect())
    tables.write_results(ce, str(tmp_path / "ce"), {"cap": 3})
    assert spark.read.parquet(str(tmp_path / "ce")).filter("param_cap = 3").count() == 3
    stats = spark.createDataFrame([("all", 5, 2.0), ("topic", 3, 1.0)], "slice string, n_rows long, mean double")
    tables.write_stats(stats, "slice", str(tmp_path / "stats"), ["all", "topic"])
    assert {r["statistic"]: (float(r["all"]), float(r["topic"])) for r in spark.read.csv(str(tmp_path / "stats"), header=True).collect()} == {"n_rows": (5, 3), "mean": (2, 1)}
    contributions = spark.createDataFrame([(1, dt.date(2020, 1, 1)), (2, dt.date(2020, 2, 1))], "uid long, date date")
    tables.write_corpus({"contributions": contributions}, str(tmp_path / "corpus"))
    assert tables.read_corpus(spark, str(tmp_path / "corpus"), ["contributions"])["contributions"].filter(F.col("month") == "2020-02").count() == 1


def test_database_in_parts(spark):
    url = "jdbc:derby:memory:corpus;create=true"
    options = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    contributions = spark.createDataFrame([(i if i % 50 else None, i % 7, f"text {i}") for i in range(1, 400)], "UID long, MEMBER long, BODY string")
    members = spark.createDataFrame([(i, f"m{i}") for i in range(7)], "PIMS_ID long, NAME string")
    for name, df in (("contributions", contributions), ("members", members)):
        df.coalesce(1).write.jdbc(url, name, properties=options)
    found = tables.read_database(spark, url, ["contributions", "members"], partitions=5, **options)
    assert found["contributions"].rdd.getNumPartitions() == 5 and found["members"].rdd.getNumPartitions() == 1
    for name, df in (("contributions", contributions), ("members", members)):
        assert sorted(map(str, found[name].collect())) == sorted(map(str, df.collect()))
    parts = tables.read_database(spark, url, ["contributions"], predicates={"contributions": ["MEMBER < 3", "MEMBER >= 3"]}, **options)["contributions"]
    assert parts.rdd.getNumPartitions() == 2 and sorted(map(str, parts.collect())) == sorted(map(str, contributions.collect()))
    empty = spark.createDataFrame([], contributions.schema)
    empty.write.jdbc(url, "nothing", properties=options)
    assert tables.read_database(spark, url, ["nothing"], {"nothing": "UID"}, **options)["nothing"].isEmpty()


def many_members(folder, n):
    inner = zipped(**{f"CHAN{1000 + i}__xml": XML for i in range(5)})
    with zipfile.ZipFile(folder / "many.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for i in range(n):
            z.writestr(f"some/folder/CHAN{i}.xml", XML + " " * i, zipfile.ZIP_STORED if i % 3 == 0 else zipfile.ZIP_DEFLATED)
        z.writestr("inner.zip", inner)
        z.writestr("other.txt", "x" * 100_000)


def test_members_of_one_archive_are_spread(spark, tmp_path):
    many_members(tmp_path, 40)
    (tmp_path / "empty.zip").write_bytes(zipped())
    found = transcripts.read_archives(spark, str(tmp_path), partitions=8)
    got = {r["file"]: bytes(r["content"]) for r in found.collect()}
    assert got == {f"CHAN{i}.xml": (XML + " " * i).encode() for i in range(40)} | {f"CHAN{1000 + i}.xml": XML.encode() for i in range(5)}
    assert found.select(F.spark_partition_id()).distinct().count() > 4
    assert transcripts.archive_members(spark, str(tmp_path)).filter("packed is not null or size > 5000").isEmpty()


def test_archives_in_a_store_that_only_spark_reads(spark, tmp_path, monkeypatch):
    many_members(tmp_path, 6)
    monkeypatch.setattr(transcripts, "readable_by_range", lambda path: False)
    found = transcripts.read_archives(spark, str(tmp_path), partitions=3)
    assert sorted(r["file"] for r in found.collect()) == sorted([f"CHAN{i}.xml" for i in range(6)] + [f"CHAN{1000 + i}.xml" for i in range(5)])
    assert transcripts.archive_members(spark, str(tmp_path)).filter("packed is null").isEmpty()


def test_which_stores_tasks_can_open(tmp_path):
    assert transcripts.readable_by_range(str(tmp_path)) and transcripts.readable_by_range(f"file://{tmp_path}")
    assert not transcripts.readable_by_range("viewfs://store/in") and not transcripts.readable_by_range(str(tmp_path / "nowhere"))


def test_what_operators_wrote_can_be_dropped(spark):
    found = files.stored(spark.range(3), "some")
    assert found.count() == 3
    path = files._written[-1]
    assert files.drop_written(spark) > 0 and not files._written
    with_path = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet")
    with pytest.raises(AnalysisException):
        with_path.load(path)
