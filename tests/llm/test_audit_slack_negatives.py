"""Filter audit, minimum slack packing and hard negatives against brute force, with nulls, empty tables, repeats and clashing columns."""

import collections
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from langdrift.llm import filter_audit, hard_negatives, slack
from langdrift.llm.token_ids import ByteCachedTokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]

# filter audit


def masks_by_hand(rows):
    """The letters that each (doc_id, text, source) fails."""
    out = []
    for doc, text, _ in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = "A" * (len(words) < 50) + "B" * (100 * len(set(words)) < 65 * len(words)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 5 * len(t)) + "D" * bool(re.search(r"[#$%&*|]", t))
        fails += "E" * any((o or "") == t and i is not None and doc is not None and i < doc for i, o, _ in rows)
        out.append(fails)
    return out


def audit_by_hand(rows, labels):
    masks, want = masks_by_hand(rows), {}
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    for part in {s or "" for _, _, s in rows}:
        own = [(i, m) for (i, _, s), m in zip(rows, masks) if (s or "") == part]
        shares = collections.Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = list(own)
            for k, letter in enumerate(order):
                gone = [(i, m) for i, m in left if letter in m]
                left = [(i, m) for i, m in left if letter not in m]
                redundant = sum(letter in m and any(x in m for x in order[:k]) for _, m in own)
                want[part, order, k + 1] = [len(left), len(gone), redundant, sum(m == letter for _, m in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
                shares[letter] += len(gone)
        for order in map("".join, itertools.permutations("ABCDE")):
            for k, letter in enumerate(order):
                want[part, order, k + 1].append(shares[letter])
    return want


def audited(df):
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in COUNTS] for r in df.collect()}


@pytest.fixture(scope="module")
def audit_rows():
    rng = random.Random(6)
    words = ["w%d" % i for i in range(90)] + ["ABC", "DE#"]
    texts = [" ".join(rng.choices(words[: rng.choice([5, 90, 92])], k=rng.choice([1, 49, 50, 51, 80]))) for _ in range(25)] + ["", None, "é" * 40 + "ABC", "\x0b \x0c", "tail $", "word " * 20000]
    rows = [(i, rng.choice(texts), rng.choice(["s1", "s1", "s2", "s3", None])) for i in range(120)]
    rows += [rows[3], rows[3], (rows[4][0], rows[5][1], "s2"), (None, rows[6][1], "s1"), (None, rows[6][1], "s1"), (None, None, None), (500, rows[7][1], "late")]
    labels = [(i, i % 2, int(i % 7 == 0)) for i in range(0, 120, 3)] + [(3, None, 1), (9, 1, 0), (9, 0, 0), (None, 1, 1), (9999, 1, 1)]
    return rows, labels


def test_audit_in_any_order_of_files(spark, tmp_path, audit_rows):
    rows, labels = audit_rows
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("x"))
    want = audit_by_hand(rows, labels)
    for name, order in (("rising", rows), ("falling", rows[::-1])):
        for i in range(0, len(order), 16):  # a file each, so that micro-batches see rising or falling ids
            spark.createDataFrame([(*r, 1, "x") for r in order[i : i + 16]], "doc_id long, text string, source string, mask int, part string").coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        for batches, texts in ((1, 1000), (8, 3)):
            assert audited(filter_audit.audit_filters(spark, str(tmp_path / name), known, micro_batches=batches, texts_a_bucket=texts)) == want


def test_earlier_counts_are_taken_back(spark, tmp_path):
    text = " ".join(f"w{i}" for i in range(60))
    for i in (5, 4, 3):
        spark.createDataFrame([(i, text, f"s{i}")], "doc_id long, text string, source string").coalesce(1).write.parquet(str(tmp_path / "in" / f"{9 - i}"))
    labels = spark.createDataFrame([(4, 1, 0)], "doc_id long, quality int, toxic int")
    found = filter_audit.stream_counters(spark, str(tmp_path / "in" / "*"), labels, micro_batches=3)
    assert sorted((r["part"], r["mask"], r["n"]) for r in found.filter("n < 0").collect()) == [("s4", 0, -1), ("s5", 0, -1)]
    total = {r["mask"]: (r["n"], r["good"]) for r in found.groupBy("mask").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).collect()}
    assert total == {0: (1, 0), 16: (2, 1)}


def test_audit_of_a_single_file_and_of_nothing(spark, tmp_path):
    rows = [(2, "a b", "s"), (1, "a b", "s"), (3, "A*", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(str(tmp_path / "many"))
    (single,) = (tmp_path / "many").glob("part-*.parquet")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audited(filter_audit.audit_filters(spark, str(single), labels)) == audit_by_hand(rows, [])
    spark.createDataFrame([], "doc_id long, text string, source string").write.parquet(str(tmp_path / "none"))
    assert filter_audit.audit_filters(spark, str(tmp_path / "none"), labels).count() == 0


def test_a_common_text_reaches_its_state_once_a_task():
    pd = pytest.importorskip("pandas")
    frame = pd.DataFrame({"text": ["a1" * 16] * 1000, "doc_id": range(1000, 0, -1), "part": "s", "mask": 1, "good": 0, "toxic": 0})
    out = pd.concat(filter_audit.fold_texts(7)([frame, frame]))
    assert len(out) == 2 and sorted(zip(out["mask"], out["n"])) == [(1, 2), (17, 1998)]


# minimum slack


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("aAzß é'ñ.,<|>\n\t19ÀİΣ́s "), st.characters(codec="utf-8"))), max_size=4))
def test_byte_level_ids_equal_the_tokenizers(texts):
    f = test_byte_level_ids_equal_the_tokenizers
    if not hasattr(f, "both"):
        f.both = Tokenizer.from_file(PATH), ByteCachedTokenizer(PATH, words=20)
    plain, cached = f.both
    texts = [*texts, None, "", " a", "a  b", "a ", "don't we'll", "<|endoftext|> x"]
    ids, ends = cached.encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_other_files_go_to_the_library_whole():
    other = public_tokenizers.path("word_bpe_49k.json")
    ids, ends = ByteCachedTokenizer(other).encode(pa.array(["it's A  test", None]))
    assert ids.tolist() == Tokenizer.from_file(other).encode("it's A  test", add_special_tokens=False).ids and ends.tolist() == [0, len(ids), len(ids)]


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 6), max_size=8), st.integers(1, 90))
def test_closest_multiset(counts, room):
    found = slack.closest_multiset(counts, room)
    sums = {0}
    for length, n in counts.items():
        for _ in range(n):
            sums |= {s + length for s in sums}
    assert all(0 < n <= counts[v] for v, n in found.items())
    assert sum(v * n for v, n in found.items()) == max(s for s in sums if s <= room)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 63), min_size=1, max_size=40))
def test_windows_are_full_until_less_than_one_is_left(lengths):
    windows, at = slack.SlackWindows(64), 0
    for i, n in enumerate(lengths):
        windows.add((i, 0, np.arange(n)))
    got = collections.defaultdict(set)
    while windows.tokens >= 64:
        window = windows.window()
        assert sum(len(ids) for _, _, ids in window) == 64
        for i, start, ids in window:
            assert ids.tolist() == list(range(start, start + len(ids))) and not got[i] & set(ids.tolist())
            got[i] |= set(ids.tolist())
        at += 64
    rest = [windows._take(n) for n in sorted(windows.counts) for _ in range(windows.counts[n])]
    ends = slack.powers_of_two(rest)
    sizes = [sum(len(p[2]) for p in w) for w in ends]
    assert sizes == sorted(sizes, reverse=True) and all(n & (n - 1) == 0 for n in sizes) and at + sum(sizes) == sum(lengths)
    for window in ends:
        for i, _, ids in window:
            assert not got[i] & set(ids.tolist())
            got[i] |= set(ids.tolist())
    assert all(got[i] == set(range(n)) for i, n in enumerate(lengths))


def test_packing_with_minimum_slack(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["the", "Straße", "x1", "#", "wörter,"]) for _ in range(rng.choice([0, 1, 5, 30, 200, 900]))) for _ in range(150)] + ["", None, "\n\n a  b ", "word " * 30000, "日本語 text"]
    rows = [(i, t, 7, "z") for i, t in enumerate(texts)] + [(3, texts[3], 7, "z"), (None, "no id", 7, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int, window string").repartition(3)
    plain = Tokenizer.from_file(PATH)
    found = slack.pack_windows(df, PATH, pool=40, with_ids=True, text_bytes=5000).collect()
    want = collections.Counter((i, tuple([*plain.encode(t or "", add_special_tokens=False).ids, 0])) for i, t, *_ in rows)
    sequences, pieces = collections.defaultdict(list), collections.defaultdict(list)
    for r in found:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        sequences[r["sequence_id"]].append(r)
        pieces[r["doc_id"]].append(r)
    for own in sequences.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == [sum(x["length"] for x in own[:k]) for k in range(len(own))]
        assert sum(r["length"] for r in own) == own[0]["window"] and own[0]["window"] in {1 << k for k in range(11)}
    short = [own for own in sequences.values() if own[0]["window"] < 1024]
    assert len(short) <= 3 * 10
    for doc, own in pieces.items():
        whole = [ids for (i, ids), n in want.items() for _ in range(n) if i == doc]
        assert sum(r["length"] for r in own) == sum(map(len, whole)) and {r["doc_tokens"] for r in own} == {len(w) for w in whole}
        if len(whole) == 1:
            own.sort(key=lambda r: r["start"])
            assert [r["start"] for r in own] == [sum(x["length"] for x in own[:k]) for k in range(len(own))]
            assert np.frombuffer(b"".join(r["ids"] for r in own), "<u4").tolist() == list(whole[0])
    assert slack.pack_windows(df.limit(0), PATH).count() == 0


# hard negatives


def mined_by_hand(rows, scale=256, n_positives=5, n_negatives=5, step=100, least=80, most=100):
    whole = [(i, label, [int(np.floor(scale * float(x))) for x in v]) for i, label, v in rows]
    anchors = {}
    for i, label, v in whole:
        if i % step == 0:
            anchors[i] = min(anchors.get(i, (label, v)), (label, v))
    out = []
    for a, (label, v) in anchors.items():
        scored = [(-sum(x * y for x, y in zip(v, w)), i, lab) for i, lab, w in whole if i != a]
        for s, p, _ in sorted(x for x in scored if x[2] == label)[:n_positives]:
            inside = sorted(x for x in scored if x[2] != label and least * -s <= 100 * -x[0] <= most * -s)[:n_negatives]
            out += [(a, p, k + 1, i, -s, -x) for k, (x, i, _) in enumerate(inside)]
    return sorted(out)


def mined(df, **options):
    return sorted(tuple(r) for r in hard_negatives.mine_hard_negatives(df, **options).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


SCHEMA = "vec_id long, embedding array<float>, label int, block string, anchors int"


def test_hard_negatives(spark):
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.integers(0, 3)), (rng.integers(-3, 6, 6) / 4).tolist()) for i in range(420)]  # few values: many ties
    rows += [(7, 1, rows[8][2]), (200, 0, rows[9][2]), (200, 2, rows[10][2]), (-100, 1, rows[11][2])]
    odd = [(900, 1, None), (901, None, [1.0] * 6), (None, 1, [1.0] * 6), (902, 1, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (903, 1, [float("nan")] * 6), (904, 1, [float("inf")] * 6), (905, 1, []), (906, 1, [9.0] * 7), (1000, 1, [9.0] * 7)]
    df = spark.createDataFrame([(i, v, label, "b", 1) for i, label, v in rows + odd], SCHEMA).repartition(5)
    want = mined_by_hand(rows)
    for options in ({}, {"block_rows": 50, "anchor_rows": 2}):
        assert mined(df, **options) == want
    assert len(want) > 60
    assert mined(df.limit(0)) == []
    few = [(0, 1, [1.0, 0.0]), (1, 1, [1.0, 0.5]), (2, 2, [0.9, 0.1])]
    assert mined(spark.createDataFrame([(i, v, label, "b", 1) for i, label, v in few], SCHEMA)) == mined_by_hand(few) == [(0, 1, 1, 2, 65536, 58880)]
    assert mined(spark.createDataFrame([(1, [1.0], 1, "b", 1)], SCHEMA)) == []


def test_large_components(spark):
    rng = np.random.default_rng(4)
    rows = [(i, i // 10 % 2, [float(x) for x in rng.integers(-4_000_000, 4_000_000, 8)]) for i in range(0, 300, 10)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert mined(df) == mined_by_hand(rows) != []
    one = [(0, 0, [1e12, 0.0]), (1, 0, [0.5, 3.0]), (2, 1, [0.45, 1e12])]  # far apart: no score is large
    assert mined(spark.createDataFrame(one, df.schema)) == mined_by_hand(one) != []
    with pytest.raises(Exception, match="fit a long"):
        mined(spark.createDataFrame([(0, 0, [1e12, 0.0]), (1, 0, [1e12, 0.0])], df.schema))
    with pytest.raises(ValueError, match="too large"):
        mined(spark.createDataFrame([(0, 0, [1e300, 0.0])], df.schema))


@pytest.mark.parametrize("dims, size", [(1, 2**31 - 1), (3, 2**29), (64, 100), (64, 2**27), (5000, 300), (9000, 2**20)])
def test_scores_from_residues(dims, size):
    rng = np.random.default_rng(dims)
    a, b = rng.integers(-size, size + 1, (4, dims)), rng.integers(-size, size + 1, (6, dims))
    bound = float(np.sqrt((a.astype(float) ** 2).sum(1).max() * (b.astype(float) ** 2).sum(1).max())) + 1
    primes = hard_negatives.residue_primes(dims, bound)
    assert all(((p - 1) // 2) ** 2 * min(dims, hard_negatives.COLUMNS) <= 1 << 24 for p in primes) and np.prod([float(p) for p in primes]) > 2 * bound
    want = [[sum(int(x) * int(y) for x, y in zip(r, c)) for c in b] for r in a]
    assert hard_negatives.signed_scores(a, b, primes).tolist() == want
