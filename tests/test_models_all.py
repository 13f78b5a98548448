"""The snapshot-model queries over all groups, windows and runs, by hand on a small fixture."""

import collections
import datetime as dt
import math
import random

import pytest

from langdrift.plans import model_queries  # noqa: F401  registers queries
from langdrift.plans.queries import QUERIES

PARTIES = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """(folder, texts): texts are (uid, member, year, party, tokens)."""
    d, rng = tmp_path_factory.mktemp("small"), random.Random(2)
    texts, items = [], []
    for uid in range(200):
        member, year = rng.randrange(50), 1992 + uid % 3
        tokens = [rng.randrange(6) for _ in range(rng.randint(1, 4))]
        texts.append((uid, member, year, PARTIES[member % 5], [f"w{t}" for t in tokens]))
        items += [(uid, k, 1, t, dt.date(year, 5, 1), 1.0) for k, t in enumerate(tokens)]
    write = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}.parquet")
    write([(u, m, dt.date(y, 5, 1), "x", 1.0) for u, m, y, _, _ in texts], "o_orderkey long, o_custkey long, o_orderdate date, o_orderpriority string, o_totalprice double", "orders")
    write([(m, PARTIES[m % 5], 1) for m in range(50)], "c_custkey long, c_mktsegment string, c_nationkey long", "customer")
    write(items, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_shipdate date, l_extendedprice double", "lineitem")
    return str(d), texts


def pairs(tokens):
    return list(zip(["\u0002", *tokens], [*tokens, "\u0002"]))


def by_hand(texts):
    """models by (run, year, party), tests [(run, year, party, uid, bigrams)]"""
    grams, tests = collections.defaultdict(collections.Counter), []
    for run in range(2):
        for uid, member, year, party, tokens in texts:
            if (member + run) % 5 < 3:
                grams[run, year, party].update(pairs(tokens))
            else:
                tests.append((run, year, party, uid, pairs(tokens)))
    return grams, tests


def entropy(model, asked):
    ctx = collections.Counter()
    for (a, _), n in model.items():
        ctx[a] += n
    score = lambda a, b: (model[a, b] + 1) / (ctx[a] + 1) if model[a, b] else 0.4 * (ctx[b] + 1) / (sum(model.values()) + 1)
    return -sum(math.log2(score(a, b)) for a, b in asked) / len(asked)


def test_models_of_all_groups(spark, small):
    d, texts = small
    grams, tests = by_hand(texts)
    got = {(r["run"], r["window_no"], r["group"], r["w1"], r["w2"]): r["n"] for r in QUERIES["bigram_model_all"](spark, d).collect()}
    assert got == {(*k, *g): n for k, c in grams.items() for g, n in c.items()}
    want = {(run, year, p, party, uid): entropy(grams[run, year, p], asked) for run, year, party, uid, asked in tests for p in PARTIES if grams.get((run, year, p))}
    got = {(r["run"], r["window_no"], r["snap_group"], r["test_group"], r["uid"]): r["ce"] for r in QUERIES["ce_matrix_all"](spark, d).collect()}
    assert got == pytest.approx(want, abs=1e-6)
    snaps = collections.defaultdict(collections.Counter)
    for (run, year, _), c in grams.items():
        snaps[run, year].update(c)
    want = {(run, year - 1, uid): entropy(snaps[run, year - 1], asked) for run, year, _, uid, asked in tests if (run, year - 1) in snaps}
    got = {(r["run"], r["snapshot_no"], r["uid"]): r["ce"] for r in QUERIES["snapshot_cross_entropy_all"](spark, d).collect()}
    assert got == pytest.approx(want, abs=1e-6)
    assert {r["party"] for r in QUERIES["word2vec_groups_all"](spark, d).collect()} == {p for _, _, _, p, _ in texts}
