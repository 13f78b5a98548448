"""Hand-computed cases of the formulas."""

import datetime as dt
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from langdrift.functions import tails, text
from langdrift.operators import clusters, collocates, corpus, counts, models, sampling, significance, statistics, vectors, windows
from langdrift.plans import jobs
from langdrift.plans.queries import QUERIES


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def days(spark, n):
    return spark.range(n).select(F.col("id").alias("uid"), F.date_add(F.lit(dt.date(2020, 1, 1)), F.col("id").cast("int")).alias("date"))


def test_row_windows_drop_the_tail(spark):
    w = windows.contribution_windows(days(spark, 10), 4, 2)
    starts = w.groupBy("window_no").agg(F.min("uid").alias("s"), F.count(F.lit(1)).alias("n"))
    assert rows(starts, "window_no", "s", "n") == [(0, 0, 4), (1, 2, 4), (2, 4, 4)]
    assert windows.contribution_windows(days(spark, 4), 4, 2).isEmpty()


def test_day_windows_include_both_ends(spark):
    w = windows.time_windows(days(spark, 10), 4, 2).groupBy("window_no").agg(F.min("uid").alias("s"), F.count(F.lit(1)).alias("n"))
    assert rows(w, "window_no", "s", "n") == [(0, 0, 4), (1, 2, 4), (2, 4, 4)]


def test_positions_do_not_depend_on_partitions(spark):
    df = spark.range(500).select(F.col("id").alias("uid"), F.date_add(F.lit(dt.date(2020, 1, 1)), (F.col("id") * 7 % 11).cast("int")).alias("date"))
    order = {u: i for i, (d, u) in enumerate(sorted((r["date"], r["uid"]) for r in df.collect()))}
    for n in (1, 64):
        assert {r["uid"]: r["position"] for r in windows.row_positions(df.repartition(n)).collect()} == order


@pytest.mark.parametrize("n,expected", [(3, 0), (4, 1), (6, 1), (7, 2), (0, 0)])
def test_chunks(spark, n, expected):
    df = spark.createDataFrame([(1, [str(i) for i in range(n)])], "uid long, tokens array<string>")
    assert windows.make_chunks(df, 3).count() == expected


def test_member_split_sizes(spark):
    members = spark.range(10).select(F.lit("g").alias("group"), F.col("id").alias("member"))
    split = sampling.split_members(members, 2, seed=1)
    assert rows(split.groupBy("run", "role").count(), "run", "role", "count") == [(0, "snapshot", 6), (0, "test", 4), (1, "snapshot", 6), (1, "test", 4)]
    assert split.groupBy("run", "member").count().filter("count > 1").isEmpty()


def texts(spark, *tokens):
    return spark.createDataFrame([(0, 0, "g", i, list(t)) for i, t in enumerate(tokens)], "run int, window_no int, group string, uid long, tokens array<string>")


def ce(spark, train, test):
    keys = ["window_no"]
    model = models.train_bigrams(texts(spark, train), keys)
    return models.cross_entropy(models.text_bigrams(texts(spark, test), ["window_no", "uid"]), model, keys, ["uid"]).first()["ce"]


def test_cross_entropy(spark):
    assert ce(spark, "ab", "ab") == pytest.approx(0, abs=1e-12)
    assert ce(spark, "ab", "ba") == pytest.approx(math.log2(5))
    assert ce(spark, "ab", "") == pytest.approx(-math.log2(0.4 * 2 / 4))


def test_divergence_of_a_model_from_itself_is_zero(spark):
    model = models.train_bigrams(texts(spark, "abcab", "ba"), ["window_no"])
    other = models.train_bigrams(texts(spark, "ccc"), ["window_no"])
    assert models.kl_divergence(model, model, ["window_no"]).first()["kld"] == pytest.approx(0, abs=1e-12)
    assert models.kl_divergence(model, other, ["window_no"]).first()["kld"] > 0


def test_rows_of_no_group_have_no_model(spark):
    data = [(0, 1, g, role, i, t) for i, (g, role, t) in enumerate([("a", "snapshot", "xyx"), (None, "snapshot", "zz"), ("a", "test", "xy"), (None, "test", "zx"), ("b", "test", "yx")])]
    sampled = spark.createDataFrame([(*r[:5], list(r[5])) for r in data], "run int, window_no int, group string, role string, uid long, tokens array<string>")
    assert rows(models.ce_matrix(sampled).filter("test_group is not null"), "snap_group", "test_group", "uid") == [("a", "a", 2), ("a", "b", 4)]
    assert rows(models.kld_matrix(sampled), "snap_group", "test_group") == [("a", "a"), ("a", "b")]


def test_log_ratio_and_likelihood(spark):
    df = spark.createDataFrame([(True, ["x"] * 3 + ["y"] * 7), (False, ["x"] + ["y"] * 9)], "t boolean, tokens array<string>")
    found = {r["word"]: r for r in counts.keyness(df, F.col("t")).collect()}
    assert found["x"]["lr"] == pytest.approx(math.log2(3.5 / 1.5))
    same = counts.keyness(df.withColumn("tokens", F.array(F.lit("x"))), F.col("t")).first()
    assert same["ll"] == pytest.approx(0, abs=1e-12)


def test_overlapping_windows_count_once_a_block(spark):
    df = windows.row_positions(days(spark, 23).withColumn("tokens", F.array((F.col("uid") % 3).cast("string"))))
    fast = counts.block_counts(df, 6, 2, [])
    slow = counts.token_counts(windows.contribution_windows(df.drop("position", "_total"), 6, 2), ["window_no"])
    assert rows(fast, "window_no", "word", "n") == rows(slow, "window_no", "word", "n")


@pytest.mark.parametrize("size, step", [(6, 2), (7, 3), (4, 5), (5, 1), (3, 3), (22, 4), (23, 1)])
def test_counts_of_windows_equal_counts_in_windows(spark, size, step):
    rng = random.Random(size * 10 + step)
    data = [(i, dt.date(2020, 1, 1) + dt.timedelta(days=rng.choice([0, 1, 1, 2, 9, 14, 25])), rng.choice("gh"), rng.random() < 0.5, [rng.choice("abc") for _ in range(rng.randrange(5))]) for i in range(23)]
    df = spark.createDataFrame(data, "uid long, date date, group string, in_subset boolean, tokens array<string>")
    by = ["group", "window_no"]
    for wide, placed in ((windows.contribution_windows(df, size, step), windows.placed_rows(df, size, step)), (windows.time_windows(df, size, step), windows.placed_days(df, size, step))):
        assert rows(counts.token_counts(placed, by), *by, "word", "n") == rows(counts.token_counts(wide, by), *by, "word", "n")
        assert rows(counts.paired_counts(placed, F.col("in_subset"), by), *by, "word", "c1", "c2", "n1", "n2") == rows(counts.paired_counts(wide, F.col("in_subset"), by), *by, "word", "c1", "c2", "n1", "n2")
        assert rows(collocates.collocates(placed, ["a"], 2, by), *by, "word", "n") == rows(collocates.collocates(wide, ["a"], 2, by), *by, "word", "n")


@pytest.mark.parametrize("cosine", [False, True])
def test_neighbours_by_falling_norm(spark, cosine):
    rng = np.random.default_rng(5)
    words = [(s, i, (rng.integers(-3, 4, 4) * rng.choice([0.01, 0.1, 1, 20])).tolist()) for s in "ab" for i in range(160)] + [("a", 900, [0.0] * 4)]
    odd = [("a", 901, None), ("a", 902, [1.0, None, 1.0, 1.0]), ("b", 903, [float("nan")] * 4), ("b", 904, [5.0] * 3), ("a", 905, [])]
    df = spark.createDataFrame(words + odd, "slice string, word long, vector array<double>").repartition(3)
    asked = df.filter("word % 20 = 0").withColumnRenamed("word", "query")
    found = vectors.neighbours(df, asked, 5, cosine, keys=["slice"], word_block=16, query_block=3).collect()
    want = []
    for s, q, v in [w for w in words if w[1] % 20 == 0]:
        scores = []
        for o, w, x in words:
            a, b = np.array(v), np.array(x)
            if cosine:
                if not a.any() or not b.any():
                    continue
                a, b = a / np.sqrt((a * a).sum()), b / np.sqrt((b * b).sum())
            if o == s and w != q and a @ b > 1e-12:
                scores.append((-round(float(a @ b), 9), w))
        want += [(s, q, -x) for x, _ in sorted(scores)[:5]]
    got = sorted((r["slice"], r["query"], round(r["score"], 9)) for r in found if r["score"] > 1e-12)
    assert [g[:2] for g in got] == [w[:2] for w in sorted(want)] and [g[2] for g in got] == pytest.approx([w[2] for w in sorted(want)])


def count_texts(rng, pair):
    """Texts in which the two words of ``pair`` stand in the same contexts, and other words in theirs."""
    topics = [[f"t{k}w{j}" for j in range(6)] for k in range(5)]
    out = []
    for i in range(400):
        own = rng.choices(topics[i % 5], k=8)
        if i % 5 == 0:
            own[rng.randrange(8)] = pair[i // 5 % 2]
        out.append(own)
    return out


def test_count_vectors_find_planted_synonyms_in_each_slice(spark):
    rng = random.Random(3)
    planted = {"x": ("rise", "growth"), "y": ("rise", "fall")}
    data = [(s, t) for s, pair in planted.items() for t in count_texts(rng, pair)] + [(None, ["rise"] * 9), ("z", ["lone", "lone", None]), ("z", None)]
    df = spark.createDataFrame(data, "slice string, tokens array<string>")
    found = {(r["slice"], r["word"]): (r["n"], np.array(r["vector"])) for r in vectors.train_count_vectors(df, "slice", size=6, min_count=2, extra=4, bucket=10).collect()}
    want = {}
    for s, t in data:
        for w in t or []:
            if s and w:
                want[s, w] = want.get((s, w), 0) + 1
    assert {k: n for k, (n, _) in found.items()} == {k: n for k, n in want.items() if n >= 2}
    for s, (a, b) in planted.items():
        unit = {w: v / np.linalg.norm(v) for (o, w), (_, v) in found.items() if o == s and v.any()}
        best = sorted(unit, key=lambda w: -float(unit[a] @ unit[w]))
        assert b in best[1:3] and all(w.startswith("t0") or w in (a, b) for w in best[:7])


def test_count_vectors_factor_the_matrix(spark):
    """With as many dimensions as words, vectors give the matrix of absolute eigenvalues."""
    rng = random.Random(4)
    df = spark.createDataFrame([("s", rng.choices("abcdefg", weights=[9, 5, 4, 3, 2, 2, 1], k=7)) for _ in range(60)], "slice string, tokens array<string>")
    vocabulary = counts.token_counts(df, ["slice"])
    m = np.zeros((7, 7))
    for r in vectors.shifted_pmi(df, "slice", vocabulary, span=2).collect():
        m["abcdefg".index(r["w"]), "abcdefg".index(r["c"])] = r["m"]
    assert np.allclose(m, m.T) and m.any()
    found = {r["word"]: r["vector"] for r in vectors.train_count_vectors(df, "slice", size=7, span=2, min_count=1, extra=0).collect()}
    x = np.array([found[w] for w in "abcdefg"])
    values, basis = np.linalg.eigh(m)
    assert np.allclose(x @ x.T, basis @ np.diag(np.abs(values)) @ basis.T, atol=1e-6)


def vector(spark, *cells):
    return spark.createDataFrame([("g", w, x, float(v)) for w, x, v in cells], "group string, window_no int, word string, value double")


def test_agreement_measures(spark):
    v = vector(spark, (0, "a", 1), (0, "b", 2), (1, "a", 3), (1, "b", 1), (2, "c", 1))
    ac1 = {r["window_no"]: r["value"] for r in collocates.fluctuation(v, "ac1").collect()}
    assert ac1[1] == pytest.approx(1)
    assert ac1[2] < 0
    cosine = {r["window_no"]: r["value"] for r in collocates.fluctuation(v, "cosine").collect()}
    assert cosine[1] == pytest.approx(5 / math.sqrt(50)) and cosine[2] == 0
    assert {r["window_no"]: r["value"] for r in collocates.fluctuation(v, "spearman").collect()}[1] == -1


def test_collocates_count_overlapping_spans_twice(spark):
    df = spark.createDataFrame([("x n n y".split(),)], "tokens array<string>")
    assert rows(collocates.collocates(df, ["n"], 1), "word", "n") == [("n", 2), ("x", 1), ("y", 1)]


def test_tails_match_tables():
    assert tails.t_two_sided(2.228, 10) == pytest.approx(0.05, abs=1e-4)
    assert tails.t_two_sided(12.706, 1) == pytest.approx(0.05, abs=1e-4)
    assert tails.normal_two_sided(1.959964) == pytest.approx(0.05, abs=1e-6)


def test_similarity():
    def slow(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = ("".join(rng.choice(list("abcd"), rng.integers(0, 12))) for _ in range(2))
        assert tails.common_subsequence(a, b) == slow(a, b)


def test_mann_whitney_against_pairs(spark):
    a, b = [1.0, 2.0, 2.0, 5.0], [2.0, 3.0, 4.0]
    df = spark.createDataFrame([(0, "a", x) for x in a] + [(0, "b", x) for x in b], "w int, side string, ce double")
    r = significance.mann_whitney(df, ["w"]).first()
    assert r["u"] == sum((x > y) + (x == y) / 2 for x in a for y in b)


def test_paired_t_edges(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 1.0), (1, 0.0), (1, 0.0), (2, 3.0)], "w int, difference double")
    assert {r["w"]: r["t"] for r in significance.paired_t(df, ["w"]).collect()} == {0: math.inf, 1: None, 2: None}


def test_neighbour_clustering_finds_the_break():
    m = np.array([[1, 0, 0.1], [1, 0.1, 0], [1, 0, 0], [0, 1, 1], [0.1, 1, 1.0]])
    links = clusters.merge_neighbours(m)
    assert len(links) == 4 and links[-1][3] == 5
    assert clusters.cut(links, 5, 0.1) == [1, 1, 1, 2, 2]
    assert clusters.cophenetic_correlation(m) > 0.9


def test_trees_from_products_summed_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(clusters, "WORDS", 7)
    rng = np.random.default_rng(2)
    data, matrices = [], {"g": rng.random((9, 40)) * (rng.random((9, 40)) < 0.4), "h": rng.random((3, 5)), "one": rng.random((1, 2))}
    matrices["g"][4] = 0  # a window whose values are all 0
    for g, m in matrices.items():
        data += [(g, 10 * i, f"w{j}", float(v)) for i, row in enumerate(m) for j, v in enumerate(row)]
    data += [(None, 0, "w0", 1.0)]
    features = spark.createDataFrame(data, "group string, window_no int, word string, value double")
    assert clusters.inner_products(features).filter("group = 'g'").count() == 9
    for g, m in matrices.items():
        got = [tuple(r)[2:] for r in sorted(clusters.vnc(features).filter(F.col("group") == g).collect(), key=lambda r: r["step"])]
        want = clusters.merge_neighbours(m)
        assert [x[:2] + x[3:] for x in got] == [x[:2] + x[3:] for x in want] and [x[2] for x in got] == pytest.approx([x[2] for x in want])
        found = {r["window_no"]: r["cluster"] for r in clusters.vnc_clusters(features, 0.5).filter(F.col("group") == g).collect()}
        assert [found[w] for w in sorted(found)] == clusters.cut(want, len(m), 0.5)
    correlations = {r["group"]: r["correlation"] for r in clusters.cophenetic(features).collect()}
    assert correlations["g"] == pytest.approx(clusters.cophenetic_correlation(matrices["g"])) and correlations["one"] is None


def test_party_on_a_change_over_day(spark):
    d = dt.date
    rows_ = spark.createDataFrame([(1, 9, d(2020, 1, 5)), (2, 9, d(2020, 1, 10)), (3, 9, d(2019, 1, 1))], "uid long, member long, date date")
    i = spark.createDataFrame([(9, d(2020, 1, 1), d(2020, 1, 10), "A"), (9, d(2020, 1, 10), None, "B")], "member long, start date, end date, party string")
    assert rows(corpus.party_at(rows_, i), "uid", "party") == [(1, "A"), (2, "B")]


def test_fuzzy_names_match_once(spark):
    left = spark.createDataFrame([(1, "North Town"), (2, "North Twn"), (3, "Elsewhere")], "id long, place string")
    right = spark.createDataFrame([("North Town", 7), ("North Towns", 8)], "place string, code long")
    assert rows(corpus.match_fuzzy(left, right, "place", "code"), "id", "code") == [(1, 7), (2, 7)]


def test_fuzzy_names_match_as_by_comparing_all(spark):
    rng = random.Random(4)
    names = ["".join(rng.choice("abcé ") for _ in range(rng.choice([1, 2, 5, 7, 8, 12, 20, 30]))) + str(i) for i in range(150)]
    left = [(0, "Ýnys Môn Isle"), (1, ""), (2, None)]
    for i, n in enumerate(names):  # letters changed, left out and added anywhere, the first one too
        at = rng.choice([0, 0, rng.randrange(len(n))])
        left.append((i + 3, n[:at] + rng.choice(["", "x", "xy"]) + n[at + rng.choice([0, 1]) :]))
    right = [(n, i) for i, n in enumerate([*names, "Ynys Môn Isle"])]
    equal = dict(right)
    want = []
    for i, own in left:
        scores = [] if not own else [(-round(200 * tails.common_subsequence(own, n) / (len(own) + len(n))), n, k) for n, k in right]
        found = [(0, own, equal[own])] if own in equal else [x for x in scores if x[0] < -85]
        want += [(i, min(found)[2])] if found else []
    args = spark.createDataFrame(left, "id long, place string"), spark.createDataFrame(right, "place string, code long")
    assert rows(corpus.match_fuzzy(*args, "place", "code"), "id", "code") == sorted(want)
    assert (0, 150) in want


def best_and_judged(left, right):
    """Rows of (id, key, name) with the code of (key, code, name), by comparing all keys: the most similar first, then the rule."""
    ratio = lambda a, b: round(200 * tails.common_subsequence(a, b) / (len(a) + len(b))) if a and b else 0
    by_key = {}
    for k, code, n in right:
        by_key[k] = min(by_key.get(k, (code, n)), (code, n))
    out = []
    for i, k, n in left:
        if k in by_key:
            out.append((i, by_key[k][0]))
            continue
        score, key = min(((-ratio(k.lower(), o.lower()), o) for o in by_key), default=(0, None))
        code, other = by_key[key]
        if (-score > 95) if not n else (-score > 85 and ratio(n.lower(), other.lower()) > 50):
            out.append((i, code))
    return sorted(out)


def test_the_most_similar_key_is_judged_by_name(spark):
    left = [(1, "Weston super Mare and Villages", "John Smith"), (2, "Weston super Mare and Villages", ""), (3, "Weston super Mare and Villages", None), (4, "North Somersat", "Ann Lee"), (5, "North Somersat", "Bo Lund"), (6, "North Somerset", "Nobody"), (7, "north somerset", "")]
    right = [("Weston super Mare and Village", 1, "Zoe Quux"), ("North Somerset", 2, "Bo Lunde"), ("North Somersets", 3, "Ann Lee")]
    frames = spark.createDataFrame(left, "id long, place string, name string"), spark.createDataFrame(right, "place string, code long, name string")
    found = rows(corpus.match_fuzzy(*frames, "place", "code", "name"), "id", "code")
    assert found == [(2, 1), (3, 1), (5, 2), (6, 2), (7, 2)] == best_and_judged(left, right)


def test_names_judge_as_by_comparing_all(spark):
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdeé") for _ in range(n))
    right = [(f"{word(rng.randint(2, 12))} {word(rng.randint(1, 12))}", i, word(6)) for i in range(120)]
    left = []
    for i in range(250):
        k, _, n = rng.choice(right)
        at = rng.randrange(len(k))
        left.append((i, k[:at] + rng.choice(["", "x", "a", "B"]) + k[at + rng.choice([0, 1]) :], rng.choice(["", n, n[:4] + "zz", word(6)])))
    frames = spark.createDataFrame(left, "id long, place string, name string"), spark.createDataFrame(right, "place string, code long, name string")
    want = best_and_judged(left, right)
    assert rows(corpus.match_fuzzy(*frames, "place", "code", "name"), "id", "code") == want and 30 < len(want) < 250


def test_few_keys_are_compared(spark):
    """Keys of many letters share few rare pieces: far fewer pairs are compared than there are."""
    rng = random.Random(5)
    names = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(3)) for _ in range(1200)]
    for n in (300, 1200):
        keys = spark.createDataFrame([(x,) for x in names[:n]], "_key string")
        own = keys.selectExpr("replace(_key, 'a', 'o') as _own")
        compared = corpus.candidate_keys(own, keys, 85).count()
        assert n <= compared < n + 0.02 * n * n
        assert corpus.similar_keys(own, keys, 85).filter("_s > 85").count() >= 0.9 * n


#: Texts, their cleaned form and their tokens, with decomposed letters written as escapes.
CLEANED = [
    ("plain, text!! 1,234.5", "plain, text!! NUMBER, NUMBER", "plain , text ! NUMBER , NUMBER"),
    ("L'\u00e9t\u00e9 \u00e0 N\u00eemes; c\u2019est l'\u0153uvre\u2026", "l'e\u0301te\u0301 a\u0300 ni\u0302mes; c\u2019est l'\u0153uvre...", "l ' e\u0301te\u0301 a\u0300 ni\u0302mes ; c \u2019 est l ' \u0153uvre ."),
    ("Gr\u00f6\u00dfe: 12 \u00b5m  \ufb01ne \uff46\uff55\uff4c\uff4c", "gro\u0308\u00dfe: NUMBER \u03bcm fine full", "gro\u0308\u00dfe : NUMBER \u03bcm fine full"),
    ("\u00bfD\u00f3nde est\u00e1\nel A\u00f1o?", "\u00bfdo\u0301nde esta\u0301 el an\u0303o?", "\u00bf do\u0301nde esta\u0301 el an\u0303o ?"),
    ("\u65e5\u672c\u8a9e \u30c6\u30ad\u30b9\u30c8", "\u65e5\u672c\u8a9e \u30c6\u30ad\u30b9\u30c8", "\u65e5\u672c\u8a9e \u30c6\u30ad\u30b9\u30c8"),
    ("", "", ""),
    (None, None, None),
    ("re-read it's 3.14.15 (so)... _a_b x\r\ny", "re-read it's NUMBER (so)... _a_b x\r y", "re- read it ' s NUMBER ( so ) _ a_ b x y"),
]


def test_all_documents_are_cleaned_and_tokenised(spark, tmp_path):
    spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(CLEANED)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    md5 = lambda t: None if t is None else hashlib.md5(t.encode()).hexdigest()
    assert rows(QUERIES["clean_text"](spark, str(tmp_path)), "uid", "cleaned") == [(i, md5(c)) for i, (_, c, _) in enumerate(CLEANED)]
    want = [(i, None if t is None else len(t.split()), md5(t)) for i, (_, _, t) in enumerate(CLEANED)]
    assert rows(QUERIES["tokenise"](spark, str(tmp_path)), "uid", "n_tokens", "tokens") == want


def test_quantiles_of_groups(spark):
    rng = random.Random(8)
    data = [("a", float(rng.randint(0, 5))) for _ in range(301)] + [("b", rng.choice([-1e300, 1e300, 0.0, 5e-324])) for _ in range(40)] + [(None, rng.gauss(0, 1) ** 9) for _ in range(1000)] + [("one", 2.5), ("none", None), ("none", float("nan")), ("a", None)]
    found = statistics.grouped_quantiles(spark.createDataFrame(data, "g string, v double"), ["g"], "v", [0.5, 0.0, 0.9], ranges=4)
    want = {}
    for g in ("a", "b", None, "one"):
        values = sorted(v for k, v in data if k == g and v is not None)
        for q in (0.5, 0.0, 0.9):
            at = q * (len(values) - 1)
            low, high = values[math.floor(at)], values[math.ceil(at)]
            want[g, q] = low + (high - low) * (at - math.floor(at))
    assert {(r["g"], r["quantile"]): r["value"] for r in found.collect()} == pytest.approx(want)
    assert statistics.exact_quantiles(spark.createDataFrame([], "v double"), "v", [0.5]) == []


def test_positions_of_one_large_day_with_clustered_ids(spark):
    ids = [i if i < 900 else 10**12 + 7 * i for i in range(1000)] + [-5]
    data = [(dt.date(2020, 1, 2), i) for i in ids] + [(dt.date(2020, 1, 1), 10**15), (dt.date(2020, 1, 3), 1), (None, 5), (dt.date(2020, 1, 2), None)]
    df = spark.createDataFrame(data, "date date, uid long").repartition(3)
    order = {r: k for k, r in enumerate(sorted(r for r in data if None not in r))}
    placed = windows.row_positions(df, part_rows=100)
    assert {(r["date"], r["uid"]): r["position"] for r in placed.collect()} == order and placed.filter("_total <> 1003").isEmpty()


def test_text_functions(spark):
    df = spark.createDataFrame([("  Hello,World!! It's 1,234.5\nno- ﬁne ",), (None,), ("",)], "t string")
    found = [r[0] for r in df.select(text.tokenise(F.col("t"))).collect()]
    assert found[0] == ["hello", ",", "world", "!", "it", "'", "s", "NUMBER", ",", "NUMBER", "no-", "fine"] and found[1] is None and found[2] == []
    names = spark.createDataFrame([("Sir Ed Miles",), ("Rt Hon Dr. Ann Lee",), ("Lord Sir Cher",), ("baroness Pickle",), ("Mrs. Dole",), (None,)], "n string")
    assert [r[0] for r in names.select(text.display_name(F.col("n"))).collect()] == ["Ed Miles", "Rt Hon Dr. Ann Lee", "Sir Cher", "Pickle", "Mrs. Dole", None]
    assert [r[0] for r in names.select(text.is_single_word(text.display_name(F.col("n")))).collect()] == [False, False, False, True, False, None]
    votes = spark.createDataFrame([("Teller - Ayes",), ("Teller - Noes",), ("",)], "v string")
    assert [r[0] for r in votes.select(text.clean_vote(F.col("v"))).collect()] == ["aye", "no", "did-not-vote"]
    assert df.select(text.ngrams(F.array(F.lit("a"), F.lit("b"), F.lit("c")), 2)).first()[0] == ["a b", "b c"]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "uid long, member long, date date, group string, window_no int, run int, role string, tokens array<string>, party string")
    assert windows.contribution_windows(empty.drop("window_no"), 2, 1).isEmpty()
    assert counts.keywords(empty, F.col("group") == "x").isEmpty()
    assert models.ce_matrix(empty).isEmpty()
    assert collocates.collocates(empty, ["x"]).isEmpty()
    assert statistics.histogram(empty, "uid").isEmpty()


def test_snapshot_in_force(spark):
    starts = spark.createDataFrame([(0, dt.date(2020, 1, 1)), (1, dt.date(2020, 2, 1))], "window_no long, window_start date")
    t = spark.createDataFrame([(1, dt.date(2019, 1, 1)), (2, dt.date(2020, 1, 31)), (3, dt.date(2020, 2, 1))], "uid long, date date")
    assert rows(windows.snapshot_for(t, starts), "uid", "snapshot_no") == [(2, 0), (3, 1)]
    assert rows(windows.snapshot_for(t, starts, previous=True), "uid", "snapshot_no") == [(3, 0)]


def test_group_comparison_where_one_group_has_no_words(spark):
    a = spark.createDataFrame([(0, "x", 5), (0, "y", 6), (1, "x", 7)], "window_no long, word string, value long")
    b = spark.createDataFrame([(0, "x", 5), (2, "z", 8)], "window_no long, word string, value long")
    found = {r["window_no"]: r["value"] for r in collocates.group_comparison(a, b).collect()}
    ac1 = lambda agreed, pi: (agreed - 2 * pi * (1 - pi)) / (1 - 2 * pi * (1 - pi))
    assert found == pytest.approx({0: ac1(2 / 3, 1 / 2), 1: ac1(2 / 3, 1 / 6), 2: ac1(2 / 3, 1 / 6)})
    assert {r["window_no"]: r["value"] for r in collocates.group_comparison(a, b, "cosine").collect()}[1] is None


def test_grids_share_samples_and_keep_plans_apart(spark, monkeypatch):
    rng = random.Random(6)
    data = [(i, i % 7, dt.date(2020, 1, 1) + dt.timedelta(days=i), "gh"[i % 7 % 2], [rng.choice("abc") for _ in range(3)]) for i in range(60)]
    texts_ = spark.createDataFrame(data, "uid long, member long, date date, party string, tokens array<string>")
    drawn, sample = [], jobs.sample
    monkeypatch.setattr(jobs, "sample", lambda *a: drawn.append(1) or sample(*a))
    specs = [jobs.AceSpec(groups={"g": "party = 'g'", "h": "party = 'h'"}, window_size=20, window_step=20, runs=2, method=m, seed=s) for m, s in (("ce", 1), ("ce_fluct", 1), ("kld", 1), ("ce", 2))]
    found = jobs.ace_grid(texts_, specs)
    assert len(drawn) == 2 and "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()
    columns = ["window_no", "snap_group", "test_group", "n_runs", "mean"]
    for spec in (specs[0], specs[2], specs[3]):
        own = found.filter((F.col("param_method") == spec.method) & (F.col("param_seed") == spec.seed)).withColumn("mean", F.round("mean", 9))
        assert rows(own, *columns) == rows(jobs.run_ace(texts_, spec).withColumn("mean", F.round("mean", 9)), *columns) != []


def test_trees_of_many_windows_come_from_their_vectors(spark, monkeypatch):
    """No task gets all products of a group's windows where these are more than its cells."""
    rng = np.random.default_rng(3)
    monkeypatch.setattr(clusters, "BLOCK", 7)
    monkeypatch.setattr(clusters, "COLUMNS", 2)
    m = rng.random((40, 6)) * (rng.random((40, 6)) < 0.6)
    m[11] = 0
    m[:, 0] += np.arange(40) // 10
    features = spark.createDataFrame([("g", 10 * i, f"w{j}", float(v)) for i, row in enumerate(m) for j, v in enumerate(row) if v or i == 11], "group string, window_no int, word string, value double")
    want = clusters.merge_neighbours(m)
    monkeypatch.setattr(clusters, "merge_by_products", None)
    got = [tuple(r)[2:] for r in sorted(clusters.vnc(features).collect(), key=lambda r: r["step"])]
    assert [x[:2] + x[3:] for x in got] == [x[:2] + x[3:] for x in want] and [x[2] for x in got] == pytest.approx([x[2] for x in want])
    assert [r["cluster"] for r in sorted(clusters.vnc_clusters(features, 0.5).collect())] == clusters.cut(want, 40, 0.5)
    far = np.sqrt(((m[:, None] - m[None]) ** 2).sum(2))
    members, heights = {i: [i] for i in range(40)}, np.zeros((40, 40))
    for r, (a, b, height, _) in enumerate(want):
        heights[np.ix_(members[a], members[b])] = height
        members[40 + r] = members.pop(a) + members.pop(b)
    x, y = np.triu_indices(40, 1)
    assert clusters.cophenetic(features).first()["correlation"] == pytest.approx(np.corrcoef(heights[x, y], far[x, y])[0, 1])
    products = {(r["window_no"], o): p for r in clusters.pair_products(features).collect() for o, p in zip(r["others"], r["products"])}
    assert len(products) == 1600 and all(products[10 * i, 10 * j] == pytest.approx(float(m[i] @ m[j])) for i in range(40) for j in range(40))


def test_equal_vectors_are_equally_near_and_least_scores_bind(monkeypatch):
    """Copies of a vector come in order of their words, wherever they stand in a block."""
    monkeypatch.setattr(vectors, "WORD_PIECE", 50)
    monkeypatch.setattr(vectors, "QUERY_PIECE", 7)
    rng = np.random.default_rng(8)
    words = rng.normal(size=(12, 33))[rng.integers(0, 12, 301)]
    queries = np.concatenate([words[:20], 1e6 * rng.normal(size=(5, 33))])
    own = np.arange(25), np.arange(1, 26) * (np.arange(25) < 20)
    exact = sum(queries[:, None, i] * words[None, :, i] for i in range(33))
    exact[np.arange(20), np.arange(20)] = -np.inf
    least = np.where(np.arange(25) % 3 == 0, np.sort(exact, 1)[:, -5], -np.inf)
    row, word, score = vectors.best_products(queries, words, own, 9, least)
    want = [(i, j) for i in range(25) for j in sorted(range(301), key=lambda j: (-exact[i, j], j))[:9] if exact[i, j] >= least[i]]
    assert list(zip(row.tolist(), word.tolist())) == want and (score == exact[row, word]).all()


def test_divergence_counts_repeated_bigrams_and_shuffles_them_twice(spark):
    raw = [(0, g, *pair) for g, text_ in (("a", "abcabbca"), ("b", "ccabac")) for pair in zip(text_, text_[1:])]
    once = spark.createDataFrame(raw, "window_no int, group string, w1 string, w2 string").withColumn("n", F.lit(1).cast("long"))
    counted = once.groupBy("window_no", "group", "w1", "w2").agg(F.sum("n").alias("n"))
    columns = ["q_group", "p_group", "kld"]
    found, want = (rows(models.kl_divergence(m, m, ["window_no"]), *columns) for m in (once, counted))
    assert [r[:2] for r in found] == [r[:2] for r in want] and [r[2] for r in found] == pytest.approx([r[2] for r in want], abs=1e-12)
    plan = models.kl_divergence(once, once, ["window_no"])._jdf.queryExecution().executedPlan().toString()
    dealt = set(re.findall(r"Exchange hashpartitioning\([^)]*w[12]#", plan))
    assert all("w2#" not in d.replace("w1#", "") or "w1#" not in d for d in dealt)  # none by both words
