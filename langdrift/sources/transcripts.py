"""Transcript archives: nested zips, XML elements, contributions."""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FILE_NAME = re.compile(r"CHAN\d+\.xml")
FILES = "archive string, folder_date date, file string, content binary"
#: A member of an archive: where its packed bytes are, or these bytes.
MEMBERS = "archive string, folder_date date, path string, file string, method int, at long, size long, packed binary"
STORED, DEFLATED = zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED


def wanted(name: str) -> bool:
    """Transcript files, and archives that may hold some."""
    return name.lower().endswith(".zip") or FILE_NAME.fullmatch(name) is not None


def xml_members(data: bytes, depth: int = 3) -> Iterator[tuple[str, bytes]]:
    """(name, content) of the transcript files in a zip and the zips inside it, one at a time."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for info in z.infolist():
            name = info.filename.rpartition("/")[2]
            if name.lower().endswith(".zip") and depth:
                yield from xml_members(z.read(info), depth - 1)
            elif FILE_NAME.fullmatch(name):
                yield name, z.read(info)


def directory(archive) -> Iterator[tuple[str, int, int, int]]:
    """(name, method, place of the packed bytes, their number) of the wanted members of an open zip, from its directory and their headers alone."""
    with zipfile.ZipFile(archive) as z:
        for info in z.infolist():
            name = info.filename.rpartition("/")[2]
            if not info.is_dir() and wanted(name):
                if info.flag_bits & 1 or info.compress_type not in (STORED, DEFLATED):
                    raise ValueError(f"{info.filename} is encrypted or packed by a method other than deflate")
                archive.seek(info.header_offset + 26)
                name_size, extra_size = struct.unpack("<HH", archive.read(4))
                yield name, info.compress_type, info.header_offset + 30 + name_size + extra_size, info.compress_size


def readable_by_range(path: str) -> bool:
    """Whether tasks can open files of ``path`` themselves, and so read parts of them."""
    from pyarrow import fs

    try:
        system, inside = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        return system.get_file_info(inside).type != fs.FileType.NotFound
    except (ValueError, OSError, NotImplementedError):
        return False


def open_file(path: str):
    from pyarrow import fs

    system, inside = fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)
    file = system.open_input_file(inside)
    # in tiny archives zipfile seeks before the start, for which it expects another error than Arrow's files raise
    return io.BytesIO(file.read()) if file.size() < 1024 else file


def archive_members(spark: SparkSession, path: str) -> DataFrame:
    """The wanted members of all zip archives below ``path``, from their directories.

    Where tasks can open the files, nothing but directories is read, and a member is a place
    in a file; in other stores Spark's reader brings each archive (2 GB at most) and members
    are cut out of it, still packed.
    """
    by_range = readable_by_range(path)
    zips = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(path)
    date = F.regexp_extract("path", r"(\d{4}-\d{2}-\d{2})", 1)
    rows = zips.select(F.regexp_extract("path", r"([^/]+)\.zip$", 1).alias("archive"), F.to_date(F.try_to_timestamp(F.nullif(date, F.lit("")), F.lit("yyyy-MM-dd"))).alias("folder_date"), "path", *([] if by_range else ["content"]))

    def listed(batches):
        import pyarrow as pa

        types = pa.schema([("archive", pa.string()), ("folder_date", pa.date32()), ("path", pa.string()), ("file", pa.string()), ("method", pa.int32()), ("at", pa.int64()), ("size", pa.int64()), ("packed", pa.binary())])
        for batch in batches:
            for r in batch.to_pylist():
                with open_file(r["path"]) if by_range else io.BytesIO(r["content"]) as archive:
                    for name, method, at, size in directory(archive):
                        packed = None if by_range else r["content"][at : at + size]
                        yield pa.RecordBatch.from_pylist([{"archive": r["archive"], "folder_date": r["folder_date"], "path": r["path"], "file": name, "method": method, "at": at, "size": size, "packed": packed}], types)

    return rows.mapInArrow(listed, MEMBERS)


def read_archives(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """Transcript files in zip archives and the archives inside them: archive (its name), folder_date (a date in the path or null), file, content.

    Members are dealt out to ``partitions`` tasks (the session's shuffle partitions), whichever
    archive they are in; each task fetches its own, one at a time. An archive inside an
    archive is one member.
    """
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    members = archive_members(spark, path).repartition(n, "path", "at")

    def unpack(batches):
        import pyarrow as pa

        types = pa.schema([("archive", pa.string()), ("folder_date", pa.date32()), ("file", pa.string()), ("content", pa.binary())])
        for batch in batches:
            for r in batch.to_pylist():
                packed = r["packed"]
                if packed is None:
                    with open_file(r["path"]) as archive:
                        archive.seek(r["at"])
                        packed = archive.read(r["size"])
                content = zlib.decompress(packed, -zlib.MAX_WBITS) if r["method"] == DEFLATED else packed
                inside = xml_members(content) if r["file"].lower().endswith(".zip") else [(r["file"], content)]
                for name, data in inside:
                    yield pa.RecordBatch.from_pylist([{"archive": r["archive"], "folder_date": r["folder_date"], "file": name, "content": data}], types)

    return members.mapInArrow(unpack, FILES)


ELEMENTS = "archive string, file string, fragment_date string, pos int, tag string, uid string, text string, member_name string, member_id long, member_mnis long, member_xid string, contribution_type string, question_text string"


def local_name(tag) -> str:
    return tag.rpartition("}")[2] if isinstance(tag, str) else ""


def on_one_line(text: str | None) -> str:
    return (text or "").replace("\n", " ").strip()


def own_line(element) -> str | None:
    """An element's own text on one line; null where it has none."""
    return None if element is None or element.text is None else on_one_line(element.text)


def text_with_tails(element) -> str:
    """An element's own text and each of its children's tails on one line, with a space before every tail."""
    return " ".join([on_one_line(element.text), *(on_one_line(child.tail) for child in element if child.tail is not None)])


def all_text(element) -> str:
    """All text below an element, and after it, on one line."""
    return on_one_line("".join(element.itertext()) + (element.tail or ""))


def number(text: str | None) -> int | None:
    return int(text) if text and text.strip().lstrip("-").isdigit() else None


def child_named(element, name: str):
    return next((x for x in element if local_name(x.tag) == name), None)


def below_named(element, name: str):
    return next((x for x in element.iter() if local_name(x.tag) == name), None)


def elements_of(content: bytes) -> Iterator[dict]:
    """The elements of the bodies of a transcript's first debate in document order; comments and broken files give none.

    What an element says depends on its tag: headings all their text, quotes, topics and
    headings of oral answers their own (null if there is none), paragraphs their own and what
    follows their children. A question's uid and member are those of its paragraph.
    """
    try:
        root = ElementTree.fromstring(content, ElementTree.XMLParser(target=ElementTree.TreeBuilder(insert_comments=True, insert_pis=True)))
    except ElementTree.ParseError:
        return
    debate = next((x for x in root.iter() if local_name(x.tag) == "System" and x.get("type") == "Debate"), ())
    pos = 0
    for fragment in (x for x in debate if local_name(x.tag) == "Fragment"):
        header, body = child_named(fragment, "Header"), child_named(fragment, "Body")
        sitting = child_named(header, "Sitting") if header is not None else None
        for e in body if body is not None else ():
            tag = local_name(e.tag)
            if not tag:
                continue
            speech = child_named(e, "hs_Para") if tag == "Question" else e
            member = below_named(speech, "Member") if speech is not None else None
            row = {"fragment_date": sitting.get("short-date") if sitting is not None else None, "pos": pos, "tag": tag, "uid": speech.get("UID") if speech is not None else None}
            if tag.startswith("hs_2"):
                row["text"] = all_text(e)
            elif tag.startswith("hs_8") or tag in ("hs_3OralAnswers", "hs_brev"):
                row["text"] = own_line(e)
            elif tag == "hs_6bDepartment":
                row["text"] = own_line(below_named(e, "DepartmentName"))
            else:
                row["text"] = text_with_tails(speech) if speech is not None else None
            if tag == "Question" and (asked := below_named(e, "QuestionText")) is not None:
                row["question_text"] = text_with_tails(asked)
            if member is not None and "ContinuationText" in member.keys():
                row |= {"member_name": member.get("ContinuationText"), "member_id": number(member.get("PimsId")), "member_mnis": number(member.get("MnisId")), "member_xid": member.get("xid"), "contribution_type": member.get("ContributionType")}
            yield row
            pos += 1


def parse_transcripts(files: DataFrame) -> DataFrame:
    """Element rows of transcript files (archive, file, content); one file is parsed at a time."""

    def parse(batches):
        import pyarrow as pa

        names = [c.split()[0] for c in ELEMENTS.split(", ")]
        kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
        types = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ELEMENTS.split(", ")])
        for batch in batches:
            for r in batch.to_pylist():
                rows = [dict.fromkeys(names) | {"archive": r["archive"], "file": r["file"]} | e for e in elements_of(r["content"])]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, types)

    return files.select("archive", "file", "content").mapInArrow(parse, ELEMENTS)


#: A quoted block: from its start a quotation mark, text and another quotation mark; more may follow.
QUOTE = "^[“'\"].+[”'\"]"


def assemble_contributions(elements: DataFrame) -> DataFrame:
    """Contributions of element rows, by running state within a file.

    A section heading (one for oral answers only if it has a text) resets everything. A
    paragraph with a member opens a contribution, to which paragraphs without one and quoted
    blocks are added; a question is a contribution of its own, and closes the open one: what
    follows has nothing to be added to until somebody speaks. Topic and department are
    carried forward and stand with questions; a paragraph names the last question of its
    section if that is one of oral answers. Business without debate is left out, as are
    rows without a member, texts of one character or less and, of rows that repeat a uid in a
    file, all but the first.

    Result: archive, file, uid, member columns, type, section, section_tag, department, topic,
    question (its uid), date, text (of several parts with spaces between them).
    """
    order = Window.partitionBy("archive", "file").orderBy("pos")
    heading = F.col("tag").rlike(r"^hs_2\w+$") | ((F.col("tag") == "hs_3OralAnswers") & F.col("text").isNotNull())
    rows = elements.withColumn("_section", F.sum(heading.cast("int")).over(order))
    inside = Window.partitionBy("archive", "file", "_section").orderBy("pos")
    carry = lambda when, what: F.last(F.when(when, F.col(what)), ignorenulls=True).over(inside)
    rows = rows.withColumn("section", carry(heading, "text")).withColumn("section_tag", carry(heading, "tag"))
    left_out = F.coalesce(F.col("section_tag") == "hs_2BusinessWODebate", F.lit(False))
    asks = (F.col("tag") == "Question") & F.col("uid").isNotNull()
    rows = rows.withColumn("department", carry(F.col("tag") == "hs_6bDepartment", "text")).withColumn("topic", carry(F.col("tag").rlike(r"^hs_8\w+$"), "text"))
    rows = rows.withColumn("question", carry(asks, "uid"))
    speaks = (F.col("tag") == "hs_Para") & F.col("member_name").isNotNull()
    added = ((F.col("tag") == "hs_Para") & F.col("member_name").isNull()) | ((F.col("tag") == "hs_brev") & F.col("text").rlike(QUOTE))
    rows = rows.filter(~left_out & (asks | speaks | added)).withColumn("_begins", asks | speaks)
    rows = rows.withColumn("_island", F.sum(F.col("_begins").cast("int")).over(inside))
    # islands that a question begins hold the question alone
    rows = rows.withColumn("_asked", F.max(asks.cast("int")).over(Window.partitionBy("archive", "file", "_section", "_island"))).filter((F.col("_island") > 0) & ((F.col("_asked") == 0) | asks))
    said = F.when(asks, F.coalesce("question_text", "text")).otherwise(F.col("text"))
    first = lambda c: F.min_by(c, "pos").alias(c)
    keep = ["uid", "member_name", "member_id", "member_mnis", "member_xid", "contribution_type", "section", "section_tag", "department", "topic", "question", "tag", "fragment_date"]
    merged = rows.groupBy("archive", "file", "_section", "_island").agg(F.min("pos").alias("_pos"), *map(first, keep), F.array_sort(F.collect_list(F.struct("pos", said.alias("t")))).alias("_parts"))
    asked = F.col("tag") == "Question"
    done = merged.withColumn("text", F.array_join(F.transform("_parts", lambda p: p["t"]), " ")).withColumn("type", F.when(asked, "question").otherwise("contribution")).withColumnRenamed("fragment_date", "date")
    done = done.withColumn("question", F.when(~asked & (F.col("section_tag") == "hs_3OralAnswers"), F.col("question")))
    done = done.withColumn("topic", F.when(asked, F.col("topic"))).withColumn("department", F.when(asked, F.col("department")))
    done = done.filter((F.length("text") > 1) & F.col("member_name").isNotNull())
    repeats = Window.partitionBy("archive", "file", "uid").orderBy("_pos")
    return done.withColumn("_n", F.row_number().over(repeats)).filter("_n = 1").drop("_section", "_island", "_parts", "tag", "_pos", "_n")
