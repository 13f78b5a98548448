"""The training-data operators against brute force, with nulls, empty tables, repeats and clashing columns."""

import base64
import collections
import functools
import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from langdrift.llm import ann, bitplane, bitslice, jaccard, katz, licenses, mixing, packing, toxicity, warc
from langdrift.llm.token_ids import WordCachedTokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, source string, start long, class string, n long, part int, token string, length long, kind int, p double"


def make_docs(spark, rows):
    return spark.createDataFrame([(i, t, s, 0, "x", 1, 2, "t", 3, 4, 0.5) for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 4))) for _ in range(300)]
    texts = [" ".join(rng.choices(words, k=rng.choice([0, 1, 3, 5, 6, 20, 60]))) for _ in range(60)]
    base = rng.choices(words, k=80)
    for k in range(25):  # near copies around the limit
        copy = list(base)
        for _ in range(rng.randint(1, 5)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        texts.append(" ".join(copy))
    texts += [texts[10]] * 4 + ["", None, "  \n\t ", "One", "one", "ONE TWO\nthree", "x" * 5000, "word " * 30000, "<|endoftext|> it's 12 ｆｕｌｌ İstanbul &&&don't"]
    rows = [(i, t, f"s{i % 3}" if i % 7 else None) for i, t in enumerate(texts)]
    rows += [rows[5], rows[60], (None, texts[61], "s1"), (None, None, None)]
    return make_docs(spark, rows)


@pytest.fixture(scope="module")
def empty(spark):
    return make_docs(spark, [])


def ids_of(text):
    return np.array([*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 1], "<u4")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("aAzß é'ñ.,<|>\n\t19ÀİΣ́"), st.characters(codec="utf-8"))), max_size=4))
def test_cached_ids_equal_the_tokenizers(texts):
    plain = Tokenizer.from_file(PATH) if not hasattr(test_cached_ids_equal_the_tokenizers, "t") else test_cached_ids_equal_the_tokenizers.t
    test_cached_ids_equal_the_tokenizers.t = plain
    cached = test_cached_ids_equal_the_tokenizers.__dict__.setdefault("c", WordCachedTokenizer(PATH, pieces=50, words=20))
    assert [np.frombuffer(b, "<u4").tolist() for b in cached.encode(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_other_tokenizer_files_go_to_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain, texts = Tokenizer.from_file(path), ["It's 12 o'clock.  Añó", "", None, "x\ny"]
    assert [np.frombuffer(b, "<u4").tolist() for b in WordCachedTokenizer(path).encode(texts)] == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_planes_round_trip(tmp_path, planes):
    rng = np.random.default_rng(0)
    found = [(i if i != 3 else None, rng.integers(0, 2**32, n, dtype=np.uint32).astype("<u4")) for i, n in enumerate([0, 1, 7, 8, 100, 3, 64])]
    w = bitplane.PlaneWriter(f"{tmp_path}/f.idp", 8, planes, 1)
    for d, ids in found:
        w.add(d, ids.tobytes())
    w.close()
    r = bitplane.PlaneReader(f"{tmp_path}/f.idp")
    assert [(d, i.tolist()) for d, i in r.documents()] == [(d, i.tolist()) for d, i in found]
    every = np.concatenate([i for _, i in found])
    for a, b in [(0, 0), (0, 8), (5, 9), (8, 16), (0, len(every)), (100, 101)]:
        assert r.ids(a, b).tolist() == every[a:b].tolist()


def test_token_files(spark, docs, empty):
    got = bitplane.bitplane_round_trip(spark, docs, PATH, block=64, ids_a_file=2000).collect()
    want = collections.Counter((r["doc_id"], zlib.crc32(ids_of(r["text"]).tobytes())) for r in docs.collect())
    assert collections.Counter((r["doc_id"], r["ids_crc32"]) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [-1 if r["doc_id"] is None else r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order == sorted(order)
    assert bitplane.bitplane_round_trip(spark, empty, PATH).count() == 0


def test_packing(spark, docs, empty):
    got = packing.pack_documents(docs.repartition(5), PATH, capacity=256, open_bins=4, fan_in=2).collect()
    want = []
    for r in docs.collect():
        ids = ids_of(r["text"])
        want += [(r["doc_id"] or -1, k, a, len(ids[a : a + 256]), zlib.crc32(ids[a : a + 256].tobytes())) for k, a in enumerate(range(0, len(ids), 256))]
    assert sorted((r["doc_id"] or -1, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in bins.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 256
    total = sum(w[3] for w in want)
    assert len(bins) <= 1.1 * total / 256 + 2
    assert packing.pack_documents(empty, PATH).count() == 0


@pytest.mark.parametrize("fan_in", [4, 64])
def test_packing_of_many_tasks_fills_sequences(spark, fan_in):
    rng = random.Random(5)
    words = [40, 40, 40, 40, 24, 24, 24, 24]  # every second task has the short texts that fill the other's bins
    rows = [(k, "a " * (n - rng.choice([1, 1, 2]))) for k, n in enumerate(words * 12)]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 24), "doc_id long, text string")
    got = packing.pack_documents(docs, PATH, capacity=64, open_bins=4, fan_in=fan_in).collect()
    assert len(got) == len(rows)
    used = collections.Counter()
    for r in got:
        used[r["sequence_id"]] += r["length"]
    assert max(used.values()) <= 64
    assert len(used) <= 1.03 * math.ceil(sum(used.values()) / 64)


def test_best_fit_takes_the_fullest_bin_that_fits():
    fit = packing.BoundedBestFit(10, 2)
    assert [fit.place(n) for n in (6, 5, 4, 3, 8, 2)] == [(0, 0), (1, 0), (0, 6), (1, 5), (2, 0), (2, 8)]
    closing = packing.BoundedBestFit(10, 2)
    assert [closing.place(n)[0] for n in (7, 6, 8, 3, 4)] == [0, 1, 2, 1, 3]  # 0 is the fullest when 2 opens


def test_warc(spark, tmp_path):
    pages = [(5, "http://b", "same"), (3, "http://a\nx", "same"), (9, None, "same"), (1, "u", None), (2, "u", ""), (4, "u", "café"), (None, "n", "same"), (7, "u", "z" * 70000), (4, "u", "café"), (-8, "m", "café")]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, digest string")
    files = warc.write_archives(df, str(tmp_path / "w"))
    got = warc.read_archives(files, with_payload=True).collect()
    first = {}
    for p, _, h in pages:
        if p is not None:
            first[h or ""] = min(first.get(h or "", p), p)
    want = []
    for p, _, h in pages:
        body = (h or "").encode()
        revisit = p != first[h or ""]
        want.append((p, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", first[h or ""] if revisit else None))
    key = lambda r: str(tuple(r)[:5])
    assert sorted(map(key, got)) == sorted(map(key, want))
    assert all((r["payload"] is None) == (r["record_type"] == "revisit") for r in got)
    assert warc.warc_round_trip(spark, df.limit(0)).count() == 0
    few = warc.warc_round_trip(spark, df, min_bytes=5).collect()
    assert {r["record_type"] for r in few if r["payload_bytes"] < 5} == {"response"}
    with_ids = warc.write_archives(df, str(tmp_path / "v")).collect()
    import gzip

    heads = [h for f in with_ids for h in gzip.open(f["file"]).read().split(b"WARC/1.1\r\n") if b"WARC-Type: re" in h]
    urns = [h.split(b"WARC-Record-ID: ")[1].split(b"\r\n")[0] for h in heads if b"X-Page-ID" in h]
    assert len(urns) == 9 and len(set(urns)) == 9
    assert {h.split(b"WARC-Refers-To: ")[1].split(b"\r\n")[0] for h in heads if b"WARC-Refers-To: " in h} <= set(urns)
    for n in (0, 1, -1, 2**63 - 1, -(2**63), 123456789012345678):
        assert warc.page_of_record_id(warc.record_id(n, "", "af" * 20)) == n
        assert warc.page_of_record_id(warc.record_id(n, "")) == n


def vectors(spark, n=400, dims=16, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in np.float32(rng.standard_normal(dims))], i) for i in range(n)]
    rows[7] = (7, rows[40][1], 7)
    rows += [(100 + i, rows[20][1], 0) for i in range(1000, 1100)]
    rows += [(5000, None, 0), (5020, [0.0] * dims, 0), (5040, [float("nan")] * dims, 0), (5060, [None] * dims, 0), (5080, [float("inf")] + [0.0] * (dims - 1), 0), (5100, [], 0), (None, [1.0] * dims, 0), (20, rows[20][1], 1)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, block int")


def usable(df, zero):
    rows = [(r["vec_id"], np.array(r["embedding"], float)) for r in df.collect() if r["vec_id"] is not None and r["embedding"] and None not in r["embedding"] and np.isfinite(r["embedding"]).all()]
    return [r for r in rows if zero or r[1].any()]


def test_nearest_neighbours(spark):
    df = vectors(spark)
    got = collections.defaultdict(list)
    for r in ann.nearest_neighbours(df, k=10, query_step=20, sample_rows=300, block_rows=64, column_block=4).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    rows = usable(df, False)
    hits = total = 0
    for q, v in {q: v for q, v in rows if q % 20 == 0}.items():
        want = sorted((math.sqrt(((v - w) ** 2).sum()), i) for i, w in rows if i != q)[:10]
        own = sorted(got[q])
        assert [r for r, _, _ in own] == list(range(1, 11))
        true = {i: w for i, w in rows}
        assert all(s == pytest.approx(math.sqrt(((v - true[i]) ** 2).sum()), abs=1e-12) for _, i, s in own)
        hits += len({i for _, i in want} & {i for _, i, _ in own})
        total += 10
    assert hits / total >= 0.9
    assert set(got) == {q for q, _ in rows if q % 20 == 0}
    assert ann.nearest_neighbours(df.limit(0)).count() == 0
    few = ann.nearest_neighbours(df.filter("vec_id in (20, 21, 22)").dropDuplicates(["vec_id"]), query_step=20).collect()
    assert sorted(r["vec_id"] for r in few) == [21, 22]


def test_every_query_has_k_neighbours(spark):
    rng = np.random.default_rng(11)
    points = rng.standard_normal((600, 16)) + 3 * rng.standard_normal((12, 16))[rng.integers(0, 12, 600)]
    rows = [(min(i, 580), v.tolist()) for i, v in enumerate(points)]  # the last id has 20 rows
    rows += [(1000 + i, (v / 100 + 3000).tolist()) for i, v in enumerate(points[:100])]  # close together, far from zero
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collections.Counter(r["query_id"] for r in ann.nearest_neighbours(df, k=10, query_step=1, block_rows=64, column_block=4).collect())
    assert got == {i: 10 for i, _ in rows}


def test_bit_slices(spark):
    df = vectors(spark, dims=6)
    got = sorted(tuple(r) for r in bitslice.exact_top_k(df, k=20, query_step=20, block_rows=100, query_rows=7).select("query_id", "rank", "vec_id", "score").collect())
    rows = [(i, np.floor(64 * v).astype(np.int64)) for i, v in usable(df, True)]
    want = []
    for q, v in {q: v for q, v in rows if q % 20 == 0}.items():
        best = sorted((-int(v @ w), i) for i, w in rows if i != q)[:20]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want)
    assert bitslice.exact_top_k(df.limit(0)).count() == 0


def test_a_stray_long_vector_and_large_components(spark):
    rows = [(i, [float((i * 7 + j) % 11) - 5 for j in range(4)]) for i in range(60)]
    rows[3] = (3, [300_000.25, -400_000.5, 2.0, 1e6])
    rows[20] = (20, [1e6, -0.001, 3.0, -2e5])
    df = spark.createDataFrame([*rows, (100, [1.0] * 5)], "vec_id long, embedding array<double>")
    found = collections.defaultdict(list)
    for r in ann.nearest_neighbours(df, k=10, query_step=20).collect():
        found[r["query_id"]].append(r["vec_id"])
    assert {q: len(v) for q, v in found.items()} == {0: 10, 20: 10, 40: 10} and all(100 not in v for v in found.values())
    whole = {i: [math.floor(64 * x) for x in v] for i, v in rows}
    got = sorted(tuple(r) for r in bitslice.exact_top_k(df, k=5, query_step=20).select("query_id", "rank", "vec_id", "score").collect())
    want = []
    for q in (0, 20, 40):
        best = sorted((-sum(a * b for a, b in zip(whole[q], w)), i) for i, w in whole.items() if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == want
    large = [(7, [2e6, 0.0, 0.0, 0.0]), (40, [0.5, 3e9, 0.0, 1.0]), (41, [1e10, -2e4, 1.0, 3.0]), (42, [0.0, 2e5, 0.0, 0.0])]  # no score is beyond a long
    whole = {i: [math.floor(64 * x) for x in v] for i, v in [*((i, v) for i, v in rows if i not in (3, 7, 20, 40, 41, 42)), *large]}
    df = spark.createDataFrame([*((i, v) for i, v in rows if i not in (3, 7, 20, 40, 41, 42)), *large], df.schema)
    got = sorted(tuple(r) for r in bitslice.exact_top_k(df, k=5, query_step=20).select("query_id", "rank", "vec_id", "score").collect())
    want = []
    for q in (0, 40):
        best = sorted((-sum(a * b for a, b in zip(whole[q], w)), i) for i, w in whole.items() if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == want
    with pytest.raises(Exception, match="fit a long"):
        bitslice.exact_top_k(spark.createDataFrame([(0, [1e9, 1.0]), (1, [1e9, 2e8]), (2, [3.0, 4.0])], df.schema)).collect()
    with pytest.raises(ValueError, match="too large"):
        bitslice.exact_top_k(spark.createDataFrame([(0, [1e300, 1.0])], df.schema))


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(1, 130), st.integers(1, 9), st.integers(0, 10**6))
def test_bitmap_sums(dims, n, k, seed):
    rng = np.random.default_rng(seed)
    values, query = rng.integers(-9, 10, (n, dims)), rng.integers(-7, 8, dims)
    offset, _, slices = bitslice.build_slices(values)
    sums, constant = bitslice.add_slices(slices, query, offset)
    want = values @ query
    everything = np.packbits(np.concatenate([np.ones(n, np.uint8), np.zeros(slices.shape[2] * 64 - n, np.uint8)]), bitorder="little").view("<u8")
    assert (bitslice.values_at(sums, np.arange(n)) + constant == want).all()
    assert sorted(bitslice.top_rows(sums, everything, k).tolist()) == sorted(sorted(range(n), key=lambda i: (-want[i], i))[:k])


def components_by_hand(rows, percent=75):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        n = len(sets[a] & sets[b])
        if n and 100 * n >= percent * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return [(d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)]


@pytest.mark.parametrize("seeds", [1, 3])
def test_jaccard_components(spark, docs, seeds):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = jaccard.link_documents(docs.repartition(6), seeds=seeds).collect()
    key = lambda r: str(tuple(r))
    assert sorted(map(key, got)) == sorted(map(key, components_by_hand(rows)))


def test_jaccard_of_nothing(spark, empty):
    assert jaccard.link_documents(empty).count() == 0
    got = jaccard.link_documents(make_docs(spark, [(4, "", None), (5, None, None)])).collect()
    assert sorted(map(tuple, got)) == [(4, 0, 4), (5, 0, 5)]


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90)], "a long, b long")
    got = {r["node"]: r["root"] for r in jaccard.components(edges).collect()}
    assert got == dict.fromkeys(range(41), 0) | {90: 90, 100: 90}


def test_keep_representatives(spark, docs):
    kept = jaccard.keep_representatives(docs, jaccard.link_documents(docs))
    groups = {r[2] for r in components_by_hand([(r["doc_id"], r["text"]) for r in docs.collect()])}
    assert {r["doc_id"] for r in kept.collect()} - {None} == {g for g in groups if g is not None}
    assert kept.columns == docs.columns


def good_turing(counts):
    """Discounts of counts 1 to 5 by Katz's formula; half a count less where it gives none."""
    of = collections.Counter(counts)
    out = {}
    for r in range(1, 6):
        out[r] = (r - 0.5) / r
        if of[1] and of[r]:
            tail = 6 * of[6] / of[1]
            good = (r + 1) * of[r + 1] / of[r] / r
            if tail < 1 and 0 < (good - tail) / (1 - tail) < 1:
                out[r] = (good - tail) / (1 - tail)
    return out


def katz_by_hand(rows, order):
    texts = [(t or "").encode().lower().split() + [None] for _, t in rows]
    train = [zlib.crc32(b"" if d is None else str(d).encode()) % 5 != 1 for d, _ in rows]
    grams = [collections.Counter() for _ in range(order + 1)]
    for w, x in zip(texts, train):
        if x:
            for m in range(1, order + 1):
                padded = [0] * (m - 1) + w
                grams[m].update(tuple(padded[i : i + m]) for i in range(len(w)))
    uni = grams[1]
    n, v = sum(uni.values()), len(uni)
    d = [None] + [good_turing(grams[m].values()) for m in range(1, order + 1)]
    cut = lambda m, c: d[m].get(c, 1) * c
    unknown = 1 - sum(cut(1, c) for c in uni.values()) / n
    after = [None, None] + [collections.defaultdict(dict) for _ in range(2, order + 1)]
    for m in range(2, order + 1):
        for g, c in grams[m].items():
            after[m][g[:-1]][g[-1]] = c

    @functools.lru_cache(None)
    def context(m, h):
        total = sum(after[m][h].values())
        divisor = total + (not any(c <= 5 for c in after[m][h].values()))
        left = 1 - sum(cut(m, c) for c in after[m][h].values()) / divisor
        return divisor, left / (1 - sum(p(m - 1, h[1:], w) for w in after[m][h]))

    def p(m, h, w):
        if m == 1:
            return cut(1, uni[(w,)]) / n if uni[(w,)] else unknown
        if h not in after[m]:
            return p(m - 1, h[1:], w)
        if w in after[m][h]:
            return cut(m, after[m][h][w]) / context(m, h)[0]
        return context(m, h)[1] * p(m - 1, h[1:], w)

    out = []
    for (i, _), w, x in zip(rows, texts, train):
        padded = [0] * (order - 1) + w
        base = sum(math.log10((uni[(b,)] + 0.5) / (n + 0.5 * (v + 1))) for b in w)
        score = sum(math.log10(p(order, tuple(padded[k : k + order - 1]), w[k])) for k in range(len(w)))
        out.append((i, not x, len(w), sum(uni[(b,)] > 0 for b in w), n, base, score))
    sums = [sum(p(m, h, b) for (b,) in uni) + p(m, h, b"never seen") for m in range(2, order + 1) for h in list(after[m])[:15]]
    return out, sums


@pytest.mark.parametrize("order,hot_share", [(2, 1 / 1000), (3, 1 / 1000), (3, 1 / 20), (4, 1 / 200)])
def test_katz(spark, docs, empty, order, hot_share):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want, sums = katz_by_hand(rows, order)
    assert sums == pytest.approx([1] * len(sums))
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    got = sorted((tuple(r) for r in katz.score_documents(docs.coalesce(3), order=order, hot_share=hot_share, block_characters=3000).collect()), key=key)
    want.sort(key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert [x for r in got for x in r[5:]] == pytest.approx([x for r in want for x in r[5:]])
    assert katz.score_documents(empty, order=order).count() == 0


def test_toxicity_chain(spark, empty):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefg") for _ in range(4)) for _ in range(400)]
    rows = []
    for i in range(2400):
        text = rng.choices(words, k=rng.randint(3, 80))
        if i % 6 == 0:
            text[rng.randrange(len(text))] = rng.choice(["idiot", "scum", "zonk" + rng.choice("abcdef") * 2])
        rows.append((i, " ".join(text), i % 6 == 0))
    rows[1] = (1, None, False)
    rows[2] = (2, "", False)
    d = make_docs(spark, [(i, t, None) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, int(x), "y") for i, _, x in rows if i % 2 == 0] + [(4, None, "y"), (0, 1, "y"), (None, 1, "y")], "doc_id long, toxic int, text string")
    insult = F.when(F.col("doc_id").isin([i for i, t, _ in rows if "idiot" in (t or "")]), F.col("toxic")).otherwise(0).alias("insult")
    model = toxicity.fit_chain(d, labels.select("doc_id", insult, "toxic"), ["insult", "toxic"])
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(d, model).collect()}
    wrong = [i for i, _, x in rows if i % 2 and got[i]["rejected"] != x]
    assert len(got) == 2400 and len(wrong) <= 12, wrong
    assert not got[1]["rejected"] and not got[2]["rejected"]
    insults = [r["p_insult"] for i, r in got.items() if "idiot" in (rows[i][1] or "")]
    assert min(insults) > max(0.3, float(np.mean([r["p_insult"] for r in got.values()])))
    none = toxicity.fit_chain(d, labels.limit(0).select("doc_id", "toxic"), ["toxic"])
    assert toxicity.score_toxicity(d, none).filter("rejected").isEmpty()
    assert toxicity.score_toxicity(empty, model).count() == 0


def test_chain_equals_one_by_hand(spark):
    rng = random.Random(4)
    rows = []
    for i in range(240):
        bad, low = i % 5 == 0, i % 3 == 0
        words = rng.choices(["ab", "cde", "fghijk", "lm"], k=3) + ["zonkers"] * (bad and rng.random() < 0.9) + ["meh"] * (low and rng.random() < 0.8)
        rows.append((i, " ".join(words), int(low), int(bad)))
    d = make_docs(spark, [(i, t, None) for i, t, _, _ in rows])
    labels = spark.createDataFrame([(i, low, bad) for i, _, low, bad in rows], "doc_id long, low_quality int, toxic int")
    model = toxicity.fit_chain(d, labels, ["low_quality", "toxic"], folds=3)
    assert {"zonkers", "zonk*", "meh"} <= set(model.vocabulary) and "ab" not in model.vocabulary
    x = np.zeros((240, len(model.vocabulary)))
    for i, t, _, _ in rows:
        for w in set(t.split()):
            for f in {w, *(w[:n] + "*" for n in (3, 4, 5, 6) if len(w) >= n)} & model.vocabulary.keys():
                x[i, model.vocabulary[f]] = 1
    y, fold = np.array([r[2:] for r in rows], float), np.arange(240) % 3

    def fitted(x, extra, y):
        return toxicity.fit_logistic(*np.nonzero(x), extra, y, x.shape[1])

    def odds(link, x, extra):
        return link.bias + x @ link.weights + extra @ link.chain

    none = np.zeros((240, 0))
    held = np.zeros((240, 1))
    for k in range(3):
        link = fitted(x[fold != k], none[fold != k], y[fold != k, 0])
        held[fold == k, 0] = toxicity.sigmoid(odds(link, x, none))[fold == k]
    first, second = fitted(x, none, y[:, 0]), fitted(x, held, y[:, 1])
    p = toxicity.sigmoid(odds(first, x, none))
    want = np.column_stack([p, toxicity.sigmoid(odds(second, x, p[:, None]))])
    got = {r["doc_id"]: (r["p_low_quality"], r["p_toxic"]) for r in toxicity.score_toxicity(d, model).collect()}
    assert np.array([got[i] for i in range(240)]) == pytest.approx(want)


def test_logistic_regression_is_optimal():
    rng = np.random.default_rng(2)
    x = (rng.random((300, 6)) < 0.4).astype(float)
    extra = rng.random((300, 1))
    y = (rng.random(300) < toxicity.sigmoid(2 * x[:, 0] - x[:, 1] + extra[:, 0] - 1)).astype(float)
    link = toxicity.fit_logistic(*np.nonzero(x), extra, y, 6, ridge=3.0, steps=2000)
    z = np.column_stack([x, extra, np.ones(300)])
    w = np.concatenate([link.weights, link.chain, [link.bias]])
    gradient = z.T @ (toxicity.sigmoid(z @ w) - y) + np.array([3.0] * 7 + [0.0]) * w
    assert np.abs(gradient).max() < 1e-3


def test_toxicity_with_empty_partitions_and_nulls(spark):
    rows = [(i, "fine words here" if i % 4 else "zonk words here", i % 4 == 0) for i in range(40)]
    d = make_docs(spark, [(i, t, None) for i, t, _ in rows]).repartition(200)
    labels = spark.createDataFrame([(i, None if i == 7 else 0, int(x)) for i, _, x in rows] + [(None, 0, 1), (99, 0, 1)], "doc_id long, low_quality int, toxic int").repartition(100)
    model = toxicity.fit_chain(d, labels, ["low_quality", "toxic"])
    got = {r["doc_id"]: r["rejected"] for r in toxicity.score_toxicity(d, model).collect()}
    assert got == {i: x for i, _, x in rows} and model.rows == 39


def test_logistic_regression_separates():
    rng = np.random.default_rng(0)
    x = rng.random((400, 8)) < 0.3
    y = (x[:, 2] | x[:, 5]).astype(float)
    row, col = np.nonzero(x)
    link = toxicity.fit_logistic(row, col, np.zeros((400, 0)), y, 8)
    z = link.bias + x @ link.weights
    assert ((z > 0) == (y > 0)).all()


def entropy(weights):
    return -sum(w * math.log(w) for w in weights if w > 0)


def tempered(shares, exponent):
    powers = [s**exponent if s > 0 else 0.0 for s in shares]
    return [p / sum(powers) for p in powers]


def epochs(shares, exponent):
    ratio = [w / s for w, s in zip(tempered(shares, exponent), shares)]
    return [max(1.0, r / min(ratio)) for r in ratio]


def bisect(reached, low, high):
    """The least value in [low, high] from which ``reached`` holds."""
    if reached(low):
        return low
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (low, middle) if reached(middle) else (middle, high)
    return high


def exponent_by_hand(tokens, entropy_share, max_repeats):
    shares = [t / sum(tokens) for t in tokens if t > 0]
    if len(shares) < 2:
        return 1.0
    wanted = (entropy_share or 0.0) * math.log(len(shares))
    for_entropy = 1.0 - bisect(lambda x: entropy(tempered(shares, 1 - x)) >= wanted, 0.0, 1.0)
    for_limit = bisect(lambda e: max(epochs(shares, e)) <= max_repeats, 0.0, 1.0) if max_repeats else 0.0
    return max(for_entropy, for_limit)


def mixture_by_hand(rows, seed, entropy_share, max_repeats, budget=None):
    """Draws as (doc_id, block), from sorted lists."""
    tokens = lambda t: len((t or "").encode().split())
    by = collections.defaultdict(list)
    for d, t, s in rows:
        by[s].append((d, tokens(t)))
    n = {s: sum(x for _, x in own) for s, own in by.items()}
    shares = {s: x / sum(n.values()) for s, x in n.items()}
    e = exponent_by_hand(sorted(n.values()), entropy_share, max_repeats)
    ratio = {s: p**e / p for s, p in shares.items() if p}
    out = collections.Counter()
    for s, own in by.items():
        times = round(max(1.0, ratio[s] / min(ratio.values())), 9) if n[s] else 1.0
        if budget and n[s]:
            times = round(budget * shares[s] ** e / sum(p**e for p in shares.values() if p) / n[s], 9)
        full = int(times)
        rest = math.floor((times - full) * n[s])
        key = lambda d, b: hashlib.md5(f"{seed}|{b}".encode() + (b"" if d is None else f"|{d}".encode())).hexdigest()[:16]
        at = 0
        chosen = set()
        for k, group in itertools.groupby(sorted((key(d, full), x) for d, x in own), key=lambda r: r[0]):
            if rest and at < rest:
                chosen.add(k)
            at += sum(x for _, x in group)
        for d, _ in own:
            for b in range(full + (key(d, full) in chosen)):
                out[d, b] += 1
    return out


def test_mixing(spark, docs, empty):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    for share, limit in ((0.99, 3.0), (1.0, 2.0), (None, None)):
        got = mixing.mix_sources(docs, entropy_share=share, max_repeats=limit)
        assert got.columns == [*docs.columns, "mix_block", "mix_key", "mix_weight"]
        assert collections.Counter((r["doc_id"], r["mix_block"]) for r in got.collect()) == mixture_by_hand(rows, 17, share, limit)
    assert mixing.mix_sources(empty).count() == 0


def test_mixing_with_a_budget(spark, docs):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    tokens = sum(len((t or "").encode().split()) for _, t, _ in rows)
    for budget in (tokens // 3, tokens, 5 * tokens):
        got = collections.Counter((r["doc_id"], r["mix_block"]) for r in mixing.mix_sources(docs, entropy_share=0.9, max_repeats=None, budget=budget).collect())
        assert got == mixture_by_hand(rows, 17, 0.9, None, budget)
    with pytest.raises(ValueError, match="repeats documents more"):
        mixing.plan_mixture(docs, max_repeats=2.0, budget=3 * tokens)
    plan = mixing.plan_mixture(docs, entropy_share=1.0, max_repeats=2.0, budget=int(1.5 * tokens)).collect()
    assert max(r["epochs"] for r in plan if r["tokens"]) == pytest.approx(2.0, abs=1e-6)


def test_mixing_of_many_sources_without_broadcast(spark, docs, monkeypatch):
    want = collections.Counter(map(str, mixing.mix_sources(docs).select("doc_id", "source", "mix_block", "mix_key").collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 1)
    assert collections.Counter(map(str, mixing.mix_sources(docs).select("doc_id", "source", "mix_block", "mix_key").collect())) == want


def test_exponent_meets_its_targets(spark):
    shares = lambda tokens: spark.createDataFrame([(t / sum(tokens),) for t in tokens], "share double")
    tokens = [1000, 200, 50, 10]
    p = [t / 1260 for t in tokens]
    e, total, reached = mixing.solve_exponent(shares(tokens), 0.95, None, None)
    assert e == pytest.approx(exponent_by_hand(tokens, 0.95, None), abs=1e-12) and total == pytest.approx(sum(x**e for x in p))
    assert reached == pytest.approx(0.95, abs=1e-9)
    e, _, reached = mixing.solve_exponent(shares(tokens), 1.0, 2.0, None)
    assert max(epochs(p, e)) == pytest.approx(2.0) and reached < 0.95  # the limit defeats the entropy, and says so
    assert mixing.solve_exponent(shares([5]), 1.0, 2.0, None)[0] == 1.0


def test_licences(spark, empty):
    model = licenses.train_licence_model(spark)
    lines = ["Licensed under the Apache License, Version 2.0.", "released under the mit license", "All rights reserved.", "He lost his fishing license.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "Permission to speak, he said, was a right."]
    d = make_docs(spark, [(1, "Intro\n" + "\nfiller text\n".join(lines), None), (2, None, None), (3, "", None), (None, lines[0], None), (1, lines[2], None)])
    got = sorted(((r["doc_id"] or -1, r["paragraph"], r["family"], r["confirmed"]) for r in licenses.scan_licences(d, model).collect()))
    assert got == [(-1, 0, "Apache-2.0", True), (1, 0, "all-rights-reserved", True), (1, 1, "Apache-2.0", True), (1, 3, "MIT", True), (1, 5, "all-rights-reserved", True), (1, 9, "GPL", True), (1, 11, "CC-BY-NC", True)]
    assert licenses.scan_licences(empty, model).count() == 0
    held = [("MIT", "this library is released under the terms of the mit license"), ("GPL", "it is licensed under the gnu general public license"), ("BSD", "code is released under the 3-clause bsd license")]
    found = {r["paragraph"]: r["family"] for r in licenses.scan_licences(make_docs(spark, [(1, "\n".join(t for _, t in held), None)]), model).collect()}
    assert [found.get(i) for i in range(3)] == [f for f, _ in held]


@pytest.fixture(scope="module")
def licence_model(spark):
    rng = random.Random(8)
    words = "the of and to in is was that for it with as on this from there".split() + ["".join(rng.choice("aeinorst") for _ in range(rng.randint(3, 8))) for _ in range(200)]
    prose = spark.createDataFrame([(" ".join(rng.choices(words, k=30)),) for _ in range(300)], "text string")
    return licenses.train_licence_model(spark, negatives=prose)


def judged_by_hand(model, text):
    """(family, probability, overlap, probability of any licence) of a paragraph, from the model's weights."""
    import re

    licence_words = set(model.words)

    def grams(t):
        w = [x for x in re.split(r"[^\w]+|_", t.lower()) if x]
        return {" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1) if licence_words & set(w[i : i + n])}

    own = grams(text)
    place = {g: i for i, g in enumerate(model.vectorizer.vocabulary)}
    raw = model.classifier.interceptVector.toArray() + model.classifier.coefficientMatrix.toArray()[:, [place[g] for g in own if g in place]].sum(1)
    p = np.exp((raw - raw.max()) / model.temperature)
    p /= p.sum()
    family = model.families[1 + int(p[1:].argmax())]
    templates = [{g for g in grams(t) if " " in g} for t in licenses.TEMPLATES.get(family, [])]
    return family, float(p[1:].max()), max([len(t & own) / len(t) for t in templates if t], default=0.0), 1 - p[0]


def test_licences_equal_a_scan_by_hand(spark, licence_model, empty):
    m = licence_model
    assert m.classifier.interceptVector.toArray().argmax() == 0 and all(set(g.split()) & set(m.words) for g in m.vectorizer.vocabulary)
    pool = [t for ts in licenses.TEMPLATES.values() for t in ts] + licenses.DECOYS + ["it was there for the", "", "  ", "Nothing of the kind.", "licence", "the mit of it", "ＧＰＬ é license"]
    rng = random.Random(9)
    texts = [rng.choice(["\n", "\r\n", "\n\n"]).join(rng.choices(pool, k=rng.randint(1, 9))) for _ in range(40)]
    texts += [None, "", "word " * 30000 + "\nAll rights reserved.", "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated documentation files,\nto deal in the Software without restriction"]
    rows = [(i, t, None) for i, t in enumerate(texts)] + [(None, texts[0], None), (0, texts[0], None)]
    want = collections.Counter()
    import re

    for i, t, _ in rows:
        lines = re.split(r"\r?\n", t or "")
        has = [bool(set(re.split(r"[^\w]+|_", x.lower())) & set(m.words)) for x in lines]
        at = 0
        for held, group in itertools.groupby(range(len(lines)), key=lambda k: has[k]):
            group = list(group)
            if not held:
                continue
            found = [(k, 1, *judged_by_hand(m, lines[k])) for k in group]
            if len(group) > 1:
                found.append((group[0], len(group), *judged_by_hand(m, "\n".join(lines[k] for k in group))))
            found = [f for f in found if f[5] >= m.threshold]
            for k, n, family, p, overlap, _ in found:
                single = max([f[4] for f in found if f[1] == 1 and f[2] == family], default=0.0)
                whole = max([f[4] for f in found if f[1] > 1 and f[2] == family], default=0.0)
                if (n > 1) == (whole >= 0.6 and whole > single):
                    want[i, k, n, family, round(p, 6), round(overlap, 6), overlap >= 0.6] += 1
    got = licenses.scan_licences(make_docs(spark, rows), m).collect()
    assert collections.Counter((r["doc_id"], r["paragraph"], r["lines"], r["family"], r["probability"], r["overlap"], r["confirmed"]) for r in got) == want
    assert (len(texts) - 1, 0, 3, "MIT") in {k[:4] for k in want}
    assert licenses.scan_licences(empty, m).count() == 0


#: Wordings that no template has, and lines that are none.
OTHER_WORDINGS = [
    ("MIT", "This package is available under the MIT license."), ("MIT", "MIT licensed."), ("MIT", "Code in this repository is MIT-licensed, see LICENSE for details."), ("Apache-2.0", "Made available under the Apache License 2.0."), ("Apache-2.0", "Apache 2.0 licensed"),
    ("GPL", "The code is distributed under the GNU GPL, version 2."), ("GPL", "Covered by the terms of the GNU General Public License v2"), ("LGPL", "Available under the Lesser General Public License."), ("LGPL", "The library is under the LGPL 2.1."), ("AGPL", "The server is covered by the Affero General Public License."),
    ("BSD", "Offered under a 3-clause BSD license."), ("BSD", "This code is BSD licensed."), ("ISC", "The ISC license applies to this module."), ("EPL", "Made available under the Eclipse Public License."), ("CC-BY-SA", "Content is under a Creative Commons Attribution-ShareAlike 3.0 license."),
    ("CC-BY-NC", "Images may be used under CC BY-NC."), ("CC-BY", "Figures are released under a Creative Commons Attribution 3.0 license."), ("MPL-2.0", "Subject to the Mozilla Public License."), ("public-domain", "The author places this text in the public domain."), ("all-rights-reserved", "Copyright 1999 by the publisher, all rights reserved worldwide."),
]
OTHER_NONE = [
    "Her fishing license is valid until June.", "The driver had no license with him.", "The version of events in the paper was wrong.", "Permission was refused by the school.", "The public was free to come in.", "He reserved a table for two.", "A copy of the letter is in the file.",
    "The artist released a new record.", "Rights of way cross the field.", "The source of the river is in the hills.", "Terms of the lease were not met.", "They distributed food to the people.", "The foundation was laid in spring.", "This program was seen by many.", "The eclipse was seen in the north.",
]


def test_licences_in_other_words(spark, licence_model):
    texts = [t for _, t in OTHER_WORDINGS] + OTHER_NONE
    got = {r["doc_id"]: r["family"] for r in licenses.scan_licences(make_docs(spark, [(i, t, None) for i, t in enumerate(texts)]), licence_model).collect()}
    right = sum(got.get(i) == f for i, (f, _) in enumerate(OTHER_WORDINGS))
    found = sum(i in got for i in range(len(OTHER_WORDINGS)))
    false = [texts[i] for i in got if i >= len(OTHER_WORDINGS)]
    print(f"recall {found}/{len(OTHER_WORDINGS)}, right family {right}, false {false}, missed or wrong {[(f, t, got.get(i)) for i, (f, t) in enumerate(OTHER_WORDINGS) if got.get(i) != f]}")
    assert found >= 0.8 * len(OTHER_WORDINGS) and right >= 0.7 * len(OTHER_WORDINGS) and len(false) <= 1
