"""Queries of sampling, snapshot models, tests, collocates, vectors, clusters and files."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tails import t_p_value
from ..functions.text import pos_sequence
from ..operators import clusters, collocates, corpus, counts, models, sampling, significance, vectors, windows
from ..sources import tables as files
from ..sources.files import scratch
from . import jobs
from .bindings import CONTRIBUTIONS, TOKENS, contributions, table, token_texts, windows_sql
from .queries import ORACLE_SQL, SIZE, STANCES, STEP, query, rounded, stances, windowed

# H: sampling

_SPLIT = f"""{CONTRIBUTIONS}, mem AS (SELECT DISTINCT party AS "group", member FROM contrib), rk AS (SELECT run, "group", member,
  row_number() OVER (PARTITION BY run, "group" ORDER BY md5(concat_ws('|', '7', CAST(run AS VARCHAR), "group", CAST(member AS VARCHAR))), member) AS r, count(*) OVER (PARTITION BY run, "group") AS n FROM mem, range(3) t(run)),
  role AS (SELECT CAST(run AS INTEGER) AS run, "group", member, CASE WHEN r <= floor((n + 1) * 0.6) THEN 'snapshot' ELSE 'test' END AS role, CASE WHEN r <= floor((n + 1) * 0.6) THEN r ELSE r - floor((n + 1) * 0.6) END AS place FROM rk)"""


def grouped(spark, d) -> DataFrame:
    return contributions(spark, d).withColumn("group", F.col("party"))


@query(f"""WITH {_SPLIT} SELECT run, "group", member, role FROM role""")
def member_split(spark, d):
    return sampling.split_members(grouped(spark, d), 3, seed=7)


@query(f"""WITH {_SPLIT}, s AS (SELECT run, role, min(n) AS n FROM (SELECT run, "group", role, count(*) AS n FROM role GROUP BY ALL) GROUP BY ALL) SELECT role.run, "group", member, role.role FROM role JOIN s ON s.run = role.run AND s.role = role.role WHERE place <= s.n""")
def member_split_balanced(spark, d):
    return sampling.split_members(grouped(spark, d), 3, seed=7, balance=True)


@query(f"""WITH {CONTRIBUTIONS}, r AS (SELECT uid, party, member, row_number() OVER (PARTITION BY party, member ORDER BY md5(concat_ws('|', '3', party, CAST(member AS VARCHAR), CAST(uid AS VARCHAR))), uid) AS n FROM contrib) SELECT uid, party, member FROM r WHERE n <= 4""")
def cap_per_member(spark, d):
    return sampling.cap_per_member(contributions(spark, d), 4, 3, ["party", "member"]).select("uid", "party", "member")


@query(f"""WITH {_SPLIT}, ro AS (SELECT run, member, min(role) AS role FROM role GROUP BY ALL) SELECT run, role, count(*) AS n_texts FROM contrib JOIN ro USING (member) GROUP BY ALL""")
def reference_split(spark, d):
    rows = sampling.reference_split(grouped(spark, d), sampling.split_members(grouped(spark, d), 3, seed=7))
    return rows.groupBy("run", "role").agg(F.count(F.lit(1)).alias("n_texts"))


@query(f"""WITH {CONTRIBUTIONS}, w AS (SELECT *, year(date) AS window_no FROM contrib), m AS (SELECT party, window_no, member, count(*) AS n FROM w GROUP BY ALL HAVING count(*) >= 3),
c AS (SELECT party, window_no, member FROM (SELECT *, row_number() OVER (PARTITION BY party, window_no ORDER BY md5(concat_ws('|', '5', party, CAST(window_no AS VARCHAR), CAST(member AS VARCHAR))), member) AS r FROM m) WHERE r <= 5),
s AS (SELECT w.*, row_number() OVER (PARTITION BY w.party, w.window_no, w.member ORDER BY md5(concat_ws('|', '5', w.party, CAST(w.window_no AS VARCHAR), CAST(uid AS VARCHAR))), uid) AS r FROM w JOIN c ON w.party = c.party AND w.window_no = c.window_no AND w.member = c.member),
t AS (SELECT w.*, row_number() OVER (PARTITION BY w.party, w.window_no ORDER BY md5(concat_ws('|', '5', w.party, CAST(w.window_no AS VARCHAR), CAST(uid AS VARCHAR))), uid) AS r FROM w LEFT JOIN c ON w.party = c.party AND w.window_no = c.window_no AND w.member = c.member WHERE c.member IS NULL)
SELECT uid, 'snapshot' AS role FROM s WHERE r <= 3 UNION ALL SELECT uid, 'test' FROM t WHERE r <= 20""")
def snapshot_user_sample(spark, d):
    rows = grouped(spark, d).withColumn("window_no", F.year("date"))
    return sampling.snapshot_user_sample(rows, 5, 3, 20, seed=5).select("uid", "role")


@query(f"""WITH {CONTRIBUTIONS} SELECT year(date) AS year, month(date) AS month, arg_min(uid, (md5('9|' || CAST(uid AS VARCHAR)), uid)) AS uid FROM contrib WHERE month(date) IN (1, 4, 7, 10) GROUP BY ALL""")
def stratified_sample(spark, d):
    rows = contributions(spark, d).select("uid", F.year("date").alias("year"), F.month("date").alias("month")).filter("month in (1, 4, 7, 10)")
    return corpus.stratified_sample(rows, ["year", "month"], "uid", 9)


# G: snapshot models. Texts of all parties in yearly windows and two runs; a member's role is by its number.

_PARTIES = ["AUTOMOBILE", "BUILDING"]
_SAMPLED = f"""{TOKENS}, sam0 AS (SELECT CAST(run AS INTEGER) AS run, year(date) AS window_no, party AS "group", uid, tokens, CASE WHEN (member + run) % 5 < 3 THEN 'snapshot' ELSE 'test' END AS role FROM texts, range(2) t(run)),
  sb AS (SELECT run, window_no, "group", uid, role, unnest(list_zip(list_prepend(chr(2), tokens), list_append(tokens, chr(2)))) AS b FROM sam0), sam AS (SELECT run, window_no, "group", uid, role, b[1] AS w1, b[2] AS w2 FROM sb)"""


def sampled(spark, d) -> DataFrame:
    """Texts of every party and year in two runs, with their role."""
    rows = sampling.with_runs(token_texts(spark, d).withColumn("window_no", F.year("date")).withColumn("group", F.col("party")), 2)
    return rows.withColumn("role", F.when((F.col("member") + F.col("run")) % 5 < 3, "snapshot").otherwise("test"))


def _score_sql(asked: str, model: str, keys: str, out: str) -> str:
    """{out}: the rows of ``asked`` with score under ``model`` (keys, w1, w2, n)."""
    on = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in keys.split(", "))
    return f"""{out}_ctx AS (SELECT {keys}, w1 AS w, sum(n) AS ctx FROM {model} GROUP BY ALL), {out}_tot AS (SELECT {keys}, sum(n) AS total FROM {model} GROUP BY ALL),
  {out} AS (SELECT q.*, CASE WHEN m.n > 0 THEN (m.n + 1.0) / (c1.ctx + 1.0) ELSE 0.4 * (coalesce(c2.ctx, 0) + 1.0) / (t.total + 1.0) END AS score FROM {asked} q JOIN {out}_tot t ON {on('q', 't')}
  LEFT JOIN {model} m ON {on('q', 'm')} AND q.w1 = m.w1 AND q.w2 = m.w2 LEFT JOIN {out}_ctx c1 ON {on('q', 'c1')} AND q.w1 = c1.w LEFT JOIN {out}_ctx c2 ON {on('q', 'c2')} AND q.w2 = c2.w)"""


_SNAP = """snap AS (SELECT run, window_no, "group" AS snap_group, w1, w2, count(*) AS n FROM sam WHERE role = 'snapshot' GROUP BY ALL)"""


def _ce_sql(shift: int) -> str:
    return f"""WITH {_SAMPLED}, {_SNAP}, tst AS (SELECT run, window_no - {shift} AS window_no, "group" AS test_group, uid, w1, w2, count(*) AS n FROM sam WHERE role = 'test' GROUP BY ALL),
  ask AS (SELECT tst.*, g.snap_group FROM tst JOIN (SELECT DISTINCT run, window_no, snap_group FROM snap) g ON g.run = tst.run AND g.window_no = tst.window_no), {_score_sql("ask", "snap", "run, window_no, snap_group", "sc")},
  ce AS (SELECT run, window_no + {shift} AS window_no, snap_group, test_group, uid, -sum(n * log2(score)) / sum(n) AS ce FROM sc GROUP BY ALL)"""


@query(f"""WITH {_SAMPLED} SELECT run, window_no, "group", w1, w2, count(*) AS n FROM sam WHERE role = 'snapshot' GROUP BY ALL""", also="bigram_model_all")
def bigram_model(spark, d):
    return models.train_bigrams(sampled(spark, d).filter("role = 'snapshot'"), ["run", "window_no", "group"])


@query(_ce_sql(0) + " SELECT run, window_no, snap_group, test_group, uid, round(ce, 6) AS ce FROM ce", also="ce_matrix_all")
def ce_matrix(spark, d):
    return rounded(models.ce_matrix(sampled(spark, d)), "ce")


@query(_ce_sql(1) + """ SELECT run, window_no, snap_group AS "group", uid, round(ce, 6) AS ce FROM ce WHERE snap_group = test_group""", also="ce_fluctuation_all")
def ce_fluctuation(spark, d):
    return rounded(models.ce_fluctuation(sampled(spark, d)), "ce")


def _kld_sql(q: str, p: str, keys: str) -> str:
    return f"""uni AS (SELECT {keys}, w1, w2 FROM {q} UNION SELECT {keys}, w1, w2 FROM {p}), {_score_sql("uni", q, keys, "sq")}, {_score_sql("uni", p, keys, "sp")}"""


def _kld_select(keys: str, digits: int = 6) -> str:
    return f"SELECT {keys}, round(sum(p.score * ln(p.score / q.score)) / sum(p.score) + ln(sum(q.score) / sum(p.score)), {digits}) AS kld FROM sp p JOIN sq q USING ({keys}, w1, w2) GROUP BY ALL"


_KLD_PAIRS = f"""{_SNAP}, ts AS (SELECT run, window_no, "group" AS test_group, w1, w2, count(*) AS n FROM sam WHERE role = 'test' GROUP BY ALL),
mq AS (SELECT snap.*, g.test_group FROM snap JOIN (SELECT DISTINCT run, window_no, test_group FROM ts) g USING (run, window_no)), mp AS (SELECT ts.*, g.snap_group FROM ts JOIN (SELECT DISTINCT run, window_no, snap_group FROM snap) g USING (run, window_no)), {_kld_sql("mq", "mp", "run, window_no, snap_group, test_group")}"""
_KLD_BEFORE = f"""mq AS (SELECT run, window_no + 1 AS window_no, "group" AS grp, w1, w2, count(*) AS n FROM sam WHERE role = 'snapshot' GROUP BY ALL), mp AS (SELECT run, window_no, "group" AS grp, w1, w2, count(*) AS n FROM sam WHERE role = 'test' GROUP BY ALL), {_kld_sql("mq", "mp", "run, window_no, grp")}"""


@query(f"""WITH {_SAMPLED}, {_KLD_PAIRS} {_kld_select("run, window_no, snap_group, test_group")}""", also="kld_matrix_all")
def kld_matrix(spark, d):
    return rounded(models.kld_matrix(sampled(spark, d)), "kld")


@query(f"""WITH {_SAMPLED}, {_KLD_BEFORE} {_kld_select("run, window_no, grp")}""", also="kld_fluctuation_all")
def kld_fluctuation(spark, d):
    return rounded(models.kld_fluctuation(sampled(spark, d)), "kld").withColumnRenamed("group", "grp")


@query(f"""WITH {_SAMPLED}, snap AS (SELECT run, window_no + 1 AS snapshot_no, w1, w2, count(*) AS n FROM sam WHERE role = 'snapshot' GROUP BY ALL), ask AS (SELECT run, window_no AS snapshot_no, uid, w1, w2, count(*) AS n FROM sam WHERE role = 'test' GROUP BY ALL), {_score_sql("ask", "snap", "run, snapshot_no", "sc")}
SELECT run, snapshot_no - 1 AS snapshot_no, uid, round(-sum(n * log2(score)) / sum(n), 6) AS ce FROM sc GROUP BY ALL""", also="snapshot_cross_entropy_all")
def snapshot_cross_entropy(spark, d):
    """Each run's test texts under its own snapshot of the year before; a run and year is one snapshot number."""
    number = lambda back: F.col("run") * 10000 + F.col("window_no") - back
    rows = sampled(spark, d)
    tests = rows.filter("role = 'test'").withColumn("snapshot_no", number(1))
    found = models.snapshot_cross_entropy(tests, rows.filter("role = 'snapshot'").withColumn("window_no", number(0)))
    return rounded(found.select(F.floor(F.col("snapshot_no") / 10000).cast("int").alias("run"), (F.col("snapshot_no") % 10000).alias("snapshot_no"), "uid", "ce"), "ce")


@query(_ce_sql(0) + " SELECT run, window_no, snap_group, test_group, round(avg(ce), 6) AS mean_ce, round(stddev_samp(ce), 6) AS std_ce, count(*) AS n_texts FROM ce GROUP BY ALL", also="ace_run_means_all")
def ace_run_means(spark, d):
    return rounded(models.run_means(models.ce_matrix(sampled(spark, d))), "mean_ce", "std_ce")


@query(_ce_sql(0) + ", m AS (SELECT run, window_no, snap_group, test_group, avg(ce) AS m FROM ce GROUP BY ALL) SELECT window_no, snap_group, test_group, round(avg(m), 6) AS mean, round(stddev_samp(m), 6) AS std, count(*) AS n_runs FROM m GROUP BY ALL", also="ace_mean_std_all")
def ace_mean_std(spark, d):
    return rounded(models.mean_std(models.run_means(models.ce_matrix(sampled(spark, d)))), "mean", "std")


@query(_ce_sql(0) + ", m AS (SELECT run, window_no, snap_group, test_group, avg(ce) AS m FROM ce GROUP BY ALL) SELECT a.run, a.window_no, round(a.m - b.m, 6) AS difference FROM m a JOIN m b ON a.run = b.run AND a.window_no = b.window_no WHERE a.snap_group = 'AUTOMOBILE' AND a.test_group = 'BUILDING' AND b.snap_group = 'AUTOMOBILE' AND b.test_group = 'AUTOMOBILE'", also="ace_difference_all")
def ace_difference(spark, d):
    means = models.run_means(models.ce_matrix(sampled(spark, d)))
    return rounded(models.ace_difference(means, *_PARTIES), "difference")


@query(f"""WITH {TOKENS} SELECT CAST(run AS INTEGER) AS run, year(date) AS window_no, party AS "group", CASE WHEN (member + run) % 5 < 3 THEN 'snapshot' ELSE 'test' END AS role, count(*) AS n_texts, count(DISTINCT member) AS n_members FROM texts, range(2) t(run) GROUP BY ALL""", also="sample_meta_all")
def sample_meta(spark, d):
    return sampling.sample_meta(sampled(spark, d))


# Whole jobs. The SQL of a specification: texts in groups, windows, splits, caps, models, means across runs.


def _job_sql(spec: jobs.AceSpec, texts: str = "jobtexts") -> str:
    n = len(spec.groups)
    names, tests = ", ".join(f"'{g}'" for g in spec.groups), ", ".join(f"coalesce({p}, false)" for p in spec.groups.values())
    labelled = f"""SELECT uid, member, date, tokens, unnest(list_filter(list_transform(range(1, {n + 1}), lambda i: CASE WHEN [{tests}][i] THEN [{names}][i] END), lambda x: x IS NOT NULL)) AS "group" FROM {{}}"""
    if spec.chunk:
        cut = f"""ch0 AS (SELECT t.* EXCLUDE (tokens, uid), uid, i, tokens[i * {spec.chunk} + 1 : i * {spec.chunk} + {spec.chunk}] AS tokens FROM {texts} t, range((SELECT max(len(tokens)) FROM {texts})) r(i) WHERE len(tokens) > {spec.chunk} AND i < ceil((len(tokens) - {spec.chunk}) / {spec.chunk})),
  ch AS (SELECT * EXCLUDE (uid, i), uid * (SELECT max(i) + 1 FROM ch0) + i AS uid FROM ch0), jt AS ({labelled.format("ch")})"""
    else:
        limit = f" WHERE len(tokens) >= {spec.token_limit}" if spec.token_limit else ""
        kept = f"tokens[1 : {spec.token_limit}]" if spec.token_limit else "tokens"
        cut = f"""ch AS (SELECT * EXCLUDE (tokens), {kept} AS tokens FROM {texts}{limit}), jt AS ({labelled.format("ch")})"""
    cap = f" WHERE n <= {spec.cap}" if spec.cap else ""
    keyed = f"""row_number() OVER (PARTITION BY run, window_no, "group", role, member ORDER BY md5(concat_ws('|', '{spec.seed}', CAST(run AS VARCHAR), CAST(window_no AS VARCHAR), "group", role, CAST(member AS VARCHAR), CAST(uid AS VARCHAR))), uid) AS n"""
    least = """, sz AS (SELECT run, role, min(n) AS least FROM (SELECT run, "group", role, count(*) AS n FROM role0 GROUP BY ALL) GROUP BY ALL), role AS (SELECT role0.* FROM role0 JOIN sz USING (run, role) WHERE place <= least)""" if spec.balance else ", role AS (SELECT * FROM role0)"
    reference = f""" UNION ALL SELECT run, window_no, '{spec.reference}', role, r.member, uid, tokens FROM (SELECT DISTINCT ON (uid, window_no) uid, window_no, member, tokens FROM jr ORDER BY uid, window_no, "group") r JOIN (SELECT run, member, min(role) AS role FROM role GROUP BY ALL) USING (member)""" if spec.reference else ""
    sampled = f"""{cut}, jd AS (SELECT DISTINCT uid, date FROM jt), {windows_sql("jd", spec.window_size, spec.window_step)}, jr AS (SELECT jt.*, window_no FROM jt JOIN placed USING (uid)), mem AS (SELECT DISTINCT "group", member FROM jr),
  rk AS (SELECT run, "group", member, row_number() OVER (PARTITION BY run, "group" ORDER BY md5(concat_ws('|', '{spec.seed}', CAST(run AS VARCHAR), "group", CAST(member AS VARCHAR))), member) AS r, floor((count(*) OVER (PARTITION BY run, "group") + 1) * {spec.share}::DOUBLE) AS cut FROM mem, range({spec.runs}) t(run)),
  role0 AS (SELECT CAST(run AS INTEGER) AS run, "group", member, CASE WHEN r <= cut THEN 'snapshot' ELSE 'test' END AS role, CASE WHEN r <= cut THEN r ELSE r - cut END AS place FROM rk){least},
  sa AS (SELECT * FROM (SELECT *, {keyed} FROM (SELECT run, window_no, jr."group", role, jr.member, uid, tokens FROM jr JOIN role ON role."group" = jr."group" AND role.member = jr.member{reference})){cap}),
  sb AS (SELECT run, window_no, "group", uid, role, unnest(list_zip(list_prepend(chr(2), tokens), list_append(tokens, chr(2)))) AS b FROM sa), sam AS (SELECT run, window_no, "group", uid, role, b[1] AS w1, b[2] AS w2 FROM sb)"""
    mean = "round(avg(m), 6) AS mean, round(stddev_samp(m), 6) AS std, count(*) AS n_runs"
    if spec.method in ("ce", "ce_fluct"):
        ce = _ce_sql(int(spec.method == "ce_fluct")).replace(f"WITH {_SAMPLED}", sampled)
        if spec.method == "ce":
            return f"{ce}, m AS (SELECT run, window_no, snap_group, test_group, avg(ce) AS m FROM ce GROUP BY ALL) SELECT window_no, snap_group, test_group, {mean} FROM m GROUP BY ALL"
        return f"""{ce}, m AS (SELECT run, window_no, snap_group AS "group", avg(ce) AS m FROM ce WHERE snap_group = test_group GROUP BY ALL) SELECT window_no, "group", {mean} FROM m GROUP BY ALL"""
    if spec.method == "kld":
        return f"""{sampled}, {_KLD_PAIRS}, k AS ({_kld_select("run, window_no, snap_group, test_group", 12)}) SELECT window_no, snap_group, test_group, {mean.replace("(m)", "(kld)")} FROM k GROUP BY ALL"""
    return f"""{sampled}, {_KLD_BEFORE}, k AS ({_kld_select("run, window_no, grp", 12)}) SELECT window_no, grp AS "group", {mean.replace("(m)", "(kld)")} FROM k GROUP BY ALL"""


#: The texts of the job queries: two parties have the names that the questions ask for.
_JOB_TEXTS = """jobtexts AS (SELECT texts.* EXCLUDE (party), CASE party WHEN 'AUTOMOBILE' THEN 'Conservative' WHEN 'BUILDING' THEN 'Labour' ELSE party END AS party, ref_stance, constituency_leave FROM texts JOIN s USING (member))"""


def job_texts(spark, d) -> DataFrame:
    named = F.when(F.col("party") == "AUTOMOBILE", "Conservative").when(F.col("party") == "BUILDING", "Labour").otherwise(F.col("party"))
    return token_texts(spark, d).join(stances(spark, d), "member").withColumn("party", named)


def _grid_sql(specs: list[jobs.AceSpec]) -> str:
    literal = lambda v: "NULL" if v is None else ("true" if v else "false") if isinstance(v, bool) else f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE" if isinstance(v, float) else str(v)
    parts = []
    for spec in specs:
        more = [f"'{v}' AS {k}" for k, v in spec.labels.items()] + [f"{literal(v)} AS param_{k}" for k, v in asdict(spec).items() if k not in ("groups", "labels")]
        parts.append(f"SELECT *, {', '.join(more)} FROM (WITH {_job_sql(spec)})")
    return f"WITH {TOKENS}, {STANCES}, {_JOB_TEXTS} " + " UNION ALL BY NAME ".join(parts)


_JOB = {"window_size": 2000, "window_step": 2000, "runs": 2, "cap": 20}
_CHUNKS = jobs.AceSpec(groups={"autos": "party = 'AUTOMOBILE'", "buildings": "party = 'BUILDING'"}, balance=True, chunk=2, **_JOB)


@query(f"WITH {TOKENS}, {_job_sql(_CHUNKS, 'texts')}")
def ace_chunks_job(spark, d):
    """The whole job over chunks: groups, windows, repeated balanced splits, cross-entropy, means."""
    return rounded(jobs.run_ace(token_texts(spark, d), _CHUNKS), "mean", "std")


_GRID = [jobs.AceSpec(groups=jobs.QUESTIONS["stance"], labels={"question": "stance"}, reference="Reference", **_JOB, **how) for how in ({"chunk": 2}, {"token_limit": 2})]


@query(_grid_sql(_GRID))
def ace_grid_job(spark, d):
    """Chunked against truncated texts, with the reference group: a grid of two specifications."""
    return rounded(jobs.ace_grid(job_texts(spark, d), _GRID), "mean", "std")


_QUESTIONS = [jobs.AceSpec(groups=groups, labels={"question": name}, window_size=4000, window_step=2000, runs=2, cap=20, seed=3) for name, groups in jobs.QUESTIONS.items()]


@query(_grid_sql(_QUESTIONS))
def ace_questions_job(spark, d):
    """Every research question over overlapping windows."""
    return rounded(jobs.ace_grid(job_texts(spark, d), _QUESTIONS), "mean", "std")


_METHODS = [jobs.AceSpec(groups=jobs.QUESTIONS["party"], labels={"question": "party"}, method=m, balance=True, seed=5, **_JOB) for m in ("ce", "ce_fluct", "kld", "kld_fluct")]


@query(_grid_sql(_METHODS))
def ace_methods_job(spark, d):
    """One question by cross-entropy and divergence, of groups from each other and of windows from the window before."""
    return rounded(jobs.ace_grid(job_texts(spark, d), _METHODS), "mean", "std")


# I: tests. Runs are order statuses, windows are years.

_MEANS = f"""{CONTRIBUTIONS}, mean AS (SELECT CAST(con AS INTEGER) AS run, year(date) AS window_no, party AS "group", avg(price) AS mean_ce FROM contrib GROUP BY ALL)"""


def yearly_means(spark, d) -> DataFrame:
    return grouped(spark, d).groupBy(F.col("con").cast("int").alias("run"), F.year("date").alias("window_no"), "group").agg(F.avg("price").alias("mean_ce"))


_T = "CASE WHEN count(x) > 1 AND stddev_samp(x) > 0 THEN round(avg(x) / (stddev_samp(x) / sqrt(count(x))), 6) END AS t"


@query(f"""WITH {_MEANS}, j AS (SELECT a.window_no, a.mean_ce - b.mean_ce AS x FROM mean a JOIN mean b ON a.run = b.run AND a.window_no = b.window_no WHERE a."group" = 'AUTOMOBILE' AND b."group" = 'BUILDING') SELECT window_no, count(x) AS n, round(avg(x), 4) AS mean, {_T} FROM j GROUP BY 1""")
def paired_t_windows(spark, d):
    a, b = (yearly_means(spark, d).filter(F.col("group") == p).select("run", "window_no", F.col("mean_ce").alias(n)) for p, n in zip(_PARTIES, "ab"))
    t = significance.paired_t(a.join(b, ["run", "window_no"]).select("window_no", (F.col("a") - F.col("b")).alias("difference")), ["window_no"])
    return rounded(t, "t").withColumn("mean", F.round("mean", 4))


@query()
def significant_windows(spark, d):
    a, b = (yearly_means(spark, d).filter(F.col("group") == p) for p in _PARTIES)
    return rounded(significance.significant_windows(a, b, level=0.9), "mean", "t", "p")


@query(f"""WITH {_MEANS}, j AS (SELECT a."group", a.window_no, a.mean_ce - b.mean_ce AS x FROM mean a JOIN mean b ON a.run = b.run AND a."group" = b."group" AND a.window_no = b.window_no + 1) SELECT "group", window_no, count(x) AS n, {_T} FROM j GROUP BY ALL""")
def significant_changes(spark, d):
    t = significance.paired_t(significance.window_changes(yearly_means(spark, d)), ["group", "window_no"])
    return rounded(t.withColumn("p", t_p_value(F.col("t"), F.col("n") - 1)), "t").select("group", "window_no", "n", "t")


@query(f"""WITH {CONTRIBUTIONS}, v AS (SELECT year(date) AS window_no, con % 3 AS run, CASE WHEN party = 'AUTOMOBILE' THEN 'a' ELSE 'b' END AS side, floor(price / 1000) AS ce FROM contrib WHERE party IN ('AUTOMOBILE', 'BUILDING')),
r AS (SELECT *, count(*) OVER (PARTITION BY window_no, run, ce) AS ties, rank() OVER (PARTITION BY window_no, run ORDER BY ce) AS rk FROM v),
s AS (SELECT window_no, run, count(*) FILTER (side = 'a') AS n1, count(*) FILTER (side = 'b') AS n2, sum(rk + (ties - 1) / 2.0) FILTER (side = 'a') AS r1, sum(ties * ties - 1) AS t FROM r GROUP BY ALL)
SELECT window_no, run, n1, n2, round(r1 - n1 * (n1 + 1) / 2.0, 6) AS u, round(greatest(abs(r1 - n1 * (n1 + 1) / 2.0 - n1 * n2 / 2.0) - 0.5, 0) / sqrt(n1 * n2 / 12.0 * ((n1 + n2 + 1) - t / ((n1 + n2) * (n1 + n2 - 1.0)))), 6) AS z FROM s WHERE n1 > 0 AND n2 > 0""")
def mwu_windows(spark, d):
    c = contributions(spark, d).filter(F.col("party").isin(_PARTIES))
    rows = c.select(F.year("date").alias("window_no"), (F.col("con") % 3).alias("run"), F.when(F.col("party") == "AUTOMOBILE", "a").otherwise("b").alias("side"), F.floor(F.col("price") / 1000).cast("double").alias("ce"))
    return rounded(significance.mann_whitney(rows, ["window_no", "run"]), "u", "z")


#: Two-sided 5 per cent points of Student's t with 1 to 25 degrees of freedom, and of the normal distribution.
T_POINTS = [12.706205, 4.302653, 3.182446, 2.776445, 2.570582, 2.446912, 2.364624, 2.306004, 2.262157, 2.228139, 2.200985, 2.178813, 2.160369, 2.144787, 2.131450, 2.119905, 2.109816, 2.100922, 2.093024, 2.085963, 2.079614, 2.073873, 2.068658, 2.063899, 2.059539]
NORMAL_POINT = 1.959964
_SIGNIFICANT = f"n > 1 AND abs(t) > list_extract({T_POINTS}, CAST(n - 1 AS INTEGER))"


@query(f"""WITH {_MEANS}, j AS (SELECT a.window_no, a.mean_ce * 1.1 - b.mean_ce AS x FROM mean a JOIN mean b ON a.run = b.run AND a.window_no = b.window_no WHERE a."group" = 'AUTOMOBILE' AND b."group" = 'BUILDING'), w AS (SELECT window_no, count(x) AS n, round(avg(x), 4) AS mean, {_T} FROM j GROUP BY 1)
SELECT w.*, first_date, last_date FROM w JOIN (SELECT year(date) AS window_no, min(date) AS first_date, max(date) AS last_date FROM contrib GROUP BY 1) USING (window_no) WHERE {_SIGNIFICANT}""")
def windows_that_differ(spark, d):
    """The first group's means a tenth higher, so that there are windows to find."""
    means = yearly_means(spark, d)
    a = means.filter(F.col("group") == _PARTIES[0]).withColumn("mean_ce", F.col("mean_ce") * 1.1)
    spans = grouped(spark, d).groupBy(F.year("date").alias("window_no")).agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    found = significance.significant_windows(a, means.filter(F.col("group") == _PARTIES[1]), level=0.05, spans=spans)
    return rounded(found.drop("p"), "t").withColumn("mean", F.round("mean", 4))


@query(f"""WITH {_MEANS}, m AS (SELECT run, window_no, "group", mean_ce * (1 + window_no % 2 / 10.0) AS mean_ce FROM mean), j AS (SELECT a."group", a.window_no, a.mean_ce - b.mean_ce AS x FROM m a JOIN m b ON a.run = b.run AND a."group" = b."group" AND a.window_no = b.window_no + 1), w AS (SELECT "group", window_no, count(x) AS n, {_T} FROM j GROUP BY ALL)
SELECT * FROM w WHERE {_SIGNIFICANT}""")
def windows_that_changed(spark, d):
    """Means of odd years a tenth higher, so that there are changes to find."""
    means = yearly_means(spark, d).withColumn("mean_ce", F.col("mean_ce") * (1 + F.col("window_no") % 2 / 10))
    return rounded(significance.significant_changes(means, level=0.05), "t").select("group", "window_no", "n", "t")


@query(f"""WITH {CONTRIBUTIONS}, v AS (SELECT year(date) AS window_no, con % 3 AS run, CASE WHEN party = 'AUTOMOBILE' THEN 'a' ELSE 'b' END AS side, floor(price / 1000) + CASE WHEN party = 'AUTOMOBILE' THEN 60 ELSE 0 END AS ce FROM contrib WHERE party IN ('AUTOMOBILE', 'BUILDING')),
r AS (SELECT *, count(*) OVER (PARTITION BY window_no, run, ce) AS ties, rank() OVER (PARTITION BY window_no, run ORDER BY ce) AS rk FROM v),
s AS (SELECT window_no, run, count(*) FILTER (side = 'a') AS n1, count(*) FILTER (side = 'b') AS n2, sum(rk + (ties - 1) / 2.0) FILTER (side = 'a') AS r1, sum(ties * ties - 1) AS t FROM r GROUP BY ALL),
z AS (SELECT window_no, greatest(abs(r1 - n1 * (n1 + 1) / 2.0 - n1 * n2 / 2.0) - 0.5, 0) / sqrt(n1 * n2 / 12.0 * ((n1 + n2 + 1) - t / ((n1 + n2) * (n1 + n2 - 1.0)))) AS z FROM s WHERE n1 > 0 AND n2 > 0)
SELECT window_no, round(avg(CASE WHEN z > {NORMAL_POINT} THEN 1.0 ELSE 0.0 END), 6) AS share, count(*) AS n_runs FROM z GROUP BY 1 HAVING avg(CASE WHEN z > {NORMAL_POINT} THEN 1.0 ELSE 0.0 END) >= 0.8""")
def mwu_windows_over_runs(spark, d):
    """The first group's values 60 higher, so that most runs differ."""
    c = contributions(spark, d).filter(F.col("party").isin(_PARTIES))
    side = lambda p, more: c.filter(F.col("party") == p).select(F.year("date").alias("window_no"), (F.col("con") % 3).alias("run"), (F.floor(F.col("price") / 1000) + more).cast("double").alias("ce"))
    return rounded(significance.significant_windows_mwu(side(_PARTIES[0], 60), side(_PARTIES[1], 0)), "share")


@query(f"""WITH {_MEANS}, v AS (SELECT "group", window_no, avg(mean_ce) AS value FROM mean GROUP BY ALL), s AS (SELECT *, avg(value) OVER (PARTITION BY "group") AS m, stddev_samp(value) OVER (PARTITION BY "group") AS sd FROM v) SELECT "group", window_no, round(value, 4) AS value FROM s WHERE abs(value - m) > sd""")
def key_windows(spark, d):
    values = yearly_means(spark, d).groupBy("group", "window_no").agg(F.avg("mean_ce").alias("value"))
    return significance.key_windows(values).withColumn("value", F.round("value", 4))


# J: collocates and fluctuation

_NODES = "('w1', 'w7', 'w30')"
_COLL = f"""{TOKENS}, ix AS (SELECT uid, party, unnest(tokens) AS word, generate_subscripts(tokens, 1) AS i FROM texts), co AS (SELECT a.word AS node, b.word, count(*) AS n FROM ix a JOIN ix b ON a.uid = b.uid AND a.i <> b.i AND abs(a.i - b.i) <= 2 WHERE a.word IN {_NODES} GROUP BY ALL),
fr AS (SELECT word, count(*) AS n_word FROM ix GROUP BY 1), sc AS (SELECT co.node, co.word, co.n, nn.n_word AS n_node, fr.n_word, (SELECT sum(n_word) FROM fr) AS total FROM co JOIN fr ON fr.word = co.word JOIN fr nn ON nn.word = co.node)"""
NODES = ["w1", "w7", "w30"]


@query(f"WITH {_COLL} SELECT node, word, n FROM co")
def collocate_counts(spark, d):
    return collocates.collocates(token_texts(spark, d), NODES, span=2)


@query(f"WITH {_COLL} SELECT node, word, n, round(log2(n * total / (n_node * n_word)), 6) AS score FROM sc")
def collocates_mi(spark, d):
    return rounded(collocates.score_collocates(token_texts(spark, d), NODES, 2), "score").select("node", "word", "n", "score")


@query(f"WITH {_COLL} SELECT node, word, n, CASE WHEN n_word > n THEN round(log2(n * (total - n_node) / ((n_word - n) * n_node)), 6) END AS score FROM sc")
def collocates_lr(spark, d):
    return rounded(collocates.score_collocates(token_texts(spark, d), NODES, 2, measure="lr"), "score").select("node", "word", "n", "score")


_OVER = f"""{TOKENS}, ix AS (SELECT uid, year(date) AS window_no, party, unnest(tokens) AS word, generate_subscripts(tokens, 1) AS i FROM texts), co AS (SELECT a.word AS node, a.party, a.window_no, b.word, count(*) AS n FROM ix a JOIN ix b ON a.uid = b.uid AND a.i <> b.i AND abs(a.i - b.i) <= 5 WHERE a.word IN {_NODES} GROUP BY ALL),
fr AS (SELECT party, window_no, word, count(*) AS n_word FROM ix GROUP BY ALL), tt AS (SELECT party, window_no, sum(n_word) AS total FROM fr GROUP BY ALL),
ot AS (SELECT co.node, co.party AS "group", co.window_no, co.word, co.n AS value, log2(co.n * total / (nn.n_word * fr.n_word)) AS score FROM co JOIN fr ON fr.word = co.word AND fr.party = co.party AND fr.window_no = co.window_no JOIN fr nn ON nn.word = co.node AND nn.party = co.party AND nn.window_no = co.window_no JOIN tt ON tt.party = co.party AND tt.window_no = co.window_no WHERE co.n > 1 AND log2(co.n * total / (nn.n_word * fr.n_word)) > 0.5)"""


def over_time(spark, d) -> DataFrame:
    rows = token_texts(spark, d).withColumn("window_no", F.year("date")).withColumn("group", F.col("party"))
    return collocates.collocates_over_time(rows, NODES, least_count=1, least_score=0.5)


@query(f"""WITH {_OVER} SELECT node, "group", window_no, word, value, round(score, 6) AS score FROM ot""")
def collocates_over_time(spark, d):
    return rounded(over_time(spark, d), "score")


@query(f"""WITH {_OVER}, r AS (SELECT *, row_number() OVER (PARTITION BY node, "group", window_no ORDER BY round(score, 9) DESC, word) AS rank FROM ot) SELECT node, "group", window_no, word, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10""")
def top_collocates(spark, d):
    return collocates.top_collocates(over_time(spark, d).withColumn("score", F.round("score", 9))).select("node", "group", "window_no", "word", "rank")


_IN_WINDOWS = _OVER.replace(f"""{TOKENS}, ix AS (SELECT uid, year(date) AS window_no, party,""", f"""{TOKENS}, {windows_sql("texts", SIZE, STEP)}, ix AS (SELECT uid, window_no, party,""").replace("FROM texts), co AS", "FROM placed), co AS").replace("ON a.uid = b.uid AND a.i <> b.i", "ON a.uid = b.uid AND a.window_no = b.window_no AND a.i <> b.i")


@query(f"""WITH {_IN_WINDOWS} SELECT node, "group", window_no, word, value, round(score, 6) AS score FROM ot""")
def collocates_in_windows(spark, d):
    """Collocates in overlapping windows of rows, counted once."""
    return rounded(collocates.collocates_over_time(windowed(spark, d), NODES, least_count=1, least_score=0.5), "score")


@query(f"""WITH {TOKENS}, sp AS (SELECT min(date) AS first, max(date) - min(date) AS days FROM texts), wi AS (SELECT CAST(i AS BIGINT) AS window_no FROM range((SELECT CAST(greatest(ceil((days - 365) / 90), 0) AS BIGINT) FROM sp)) t(i))
SELECT party AS "group", window_no, word, count(*) AS n FROM (SELECT party, window_no, unnest(tokens) AS word FROM texts, sp JOIN wi ON date - first >= window_no * 90 AND date - first < window_no * 90 + 365) GROUP BY ALL""")
def day_window_counts(spark, d):
    """Words in years that begin every 90 days, counted once."""
    placed = windows.placed_days(token_texts(spark, d).withColumn("group", F.col("party")), 365, 90)
    return counts.token_counts(placed, ["group", "window_no"])


_VECTORS = f"""{TOKENS}, {windows_sql("texts", SIZE, STEP)}, ww AS (SELECT party AS "group", window_no, unnest(tokens) AS word FROM placed), vec AS (SELECT "group", window_no, word, count(*) AS value FROM ww GROUP BY ALL HAVING count(*) > 4), size AS (SELECT "group", count(DISTINCT word) AS size FROM vec GROUP BY 1),
cells AS (SELECT coalesce(a."group", b."group") AS "group", coalesce(a.window_no, b.window_no) AS window_no, coalesce(a.word, b.word) AS word, coalesce(a.value, 0) AS a, coalesce(b.value, 0) AS b FROM (SELECT "group", window_no + 1 AS window_no, word, value FROM vec) a FULL JOIN vec b ON a."group" = b."group" AND a.window_no = b.window_no AND a.word = b.word),
c AS (SELECT cells.*, size FROM cells JOIN size ON size."group" = cells."group" WHERE (cells."group", window_no) IN (SELECT ("group", window_no) FROM vec) AND (cells."group", window_no - 1) IN (SELECT ("group", window_no) FROM vec))"""
_PRESENT = "count(*) FILTER ((a > 0) <> (b > 0))"
_AC1 = f"""x AS (SELECT "group", window_no, any_value(size) AS d, {_PRESENT} AS o, count(*) FILTER (a > 0) AS na, count(*) FILTER (b > 0) AS nb FROM c GROUP BY ALL), y AS (SELECT *, (d - o) / d AS pa, ((na / d) + (nb / d)) / 2 AS pi FROM x)"""


def window_vectors(spark, d) -> DataFrame:
    return counts.token_counts(windowed(spark, d), ["group", "window_no"]).filter("n > 4").withColumnRenamed("n", "value")


@query(f"""WITH {_VECTORS}, {_AC1} SELECT "group", window_no, round((pa - 2 * pi * (1 - pi)) / (1 - 2 * pi * (1 - pi)), 6) AS value FROM y""")
def fluct_ac1(spark, d):
    return rounded(collocates.fluctuation(window_vectors(spark, d), "ac1"), "value")


@query(f"""WITH {_VECTORS} SELECT "group", window_no, round(sum(a * b) / sqrt(sum(a * a) * sum(b * b)), 6) AS value FROM c GROUP BY ALL""")
def fluct_cosine(spark, d):
    return rounded(collocates.fluctuation(window_vectors(spark, d), "cosine"), "value")


@query(f"""WITH {_VECTORS}, r AS (SELECT "group", window_no, row_number() OVER (PARTITION BY "group", window_no ORDER BY a DESC, word) - row_number() OVER (PARTITION BY "group", window_no ORDER BY b DESC, word) AS d FROM c WHERE a > 0 AND b > 0)
SELECT "group", window_no, CASE WHEN count(*) > 1 THEN round(1 - 6 * sum(d * d) / (count(*) * (count(*) * count(*) - 1)), 6) END AS value FROM r GROUP BY ALL""")
def fluct_spearman(spark, d):
    return rounded(collocates.fluctuation(window_vectors(spark, d), "spearman"), "value")


@query(f"""WITH {_VECTORS} SELECT "group", window_no, round((any_value(size) - {_PRESENT}) / any_value(size), 6) AS value FROM c GROUP BY ALL""")
def fluct_agreement(spark, d):
    return rounded(collocates.fluctuation(window_vectors(spark, d), "agreement"), "value")


@query(f"""WITH {TOKENS}, {windows_sql("texts", SIZE, STEP)}, ww AS (SELECT party, window_no, unnest(tokens) AS word FROM placed), vec AS (SELECT party, window_no, word, count(*) AS value FROM ww WHERE party IN ('AUTOMOBILE', 'BUILDING') GROUP BY ALL HAVING count(*) > 4), av AS (SELECT * FROM vec WHERE party = 'AUTOMOBILE'), bv AS (SELECT * FROM vec WHERE party = 'BUILDING'),
c AS (SELECT '' AS "group", coalesce(a.window_no, b.window_no) AS window_no, coalesce(a.value, 0) AS a, coalesce(b.value, 0) AS b, (SELECT count(DISTINCT word) FROM vec) AS size FROM av a FULL JOIN bv b ON a.window_no = b.window_no AND a.word = b.word), {_AC1}
SELECT window_no, round((pa - 2 * pi * (1 - pi)) / (1 - 2 * pi * (1 - pi)), 6) AS value FROM y""")
def group_comparison_ac1(spark, d):
    v = window_vectors(spark, d)
    return rounded(collocates.group_comparison(*(v.filter(F.col("group") == p).drop("group") for p in _PARTIES)), "value")


# K: vectors

_EMB = """e AS (SELECT vec_id AS word, label % 2 AS model, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"""
_DOT = "list_sum(list_transform(range(1, 65), lambda i: a.v[i] * b.v[i]))"


def word_vectors(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("word"), F.col("embedding").cast("array<double>").alias("vector"), (F.col("label") % 2).alias("model"), F.lit(100).cast("long").alias("n"))


@query(f"""WITH {_EMB}, s AS (SELECT a.word AS query, b.word, {_DOT} AS score FROM e a JOIN e b ON a.word <> b.word WHERE a.word % 10 = 0), r AS (SELECT query, word, row_number() OVER (PARTITION BY query ORDER BY score DESC, word) AS rank, score FROM s WHERE score > 0)
SELECT query, word, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10""")
def nearest_neighbours(spark, d):
    v = word_vectors(spark, d)
    return rounded(vectors.neighbours(v.select("word", "vector"), v.filter("word % 10 = 0").select(F.col("word").alias("query"), "vector"), 10), "score")


_SIMILAR = """u AS (SELECT word, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM e), q AS (SELECT list_transform(range(1, 65), lambda i: {expr}) AS v FROM (SELECT {terms}) z), b AS (SELECT * FROM q)
SELECT word, round({dot} / sqrt(list_sum(list_transform(b.v, lambda y: y * y))), 6) AS score FROM u a, b WHERE word NOT IN ({ids}) ORDER BY {dot} DESC, word LIMIT 10"""


def _similar(plus: list[int], minus: list[int]) -> str:
    terms = ", ".join(f"(SELECT v FROM u WHERE word = {i}) AS v{i}" for i in plus + minus)
    expr = " + ".join(f"z.v{i}[i]" for i in plus) + "".join(f" - z.v{i}[i]" for i in minus)
    return f"WITH {_EMB}, " + _SIMILAR.format(expr=expr, terms=terms, dot=_DOT, ids=", ".join(map(str, plus + minus)))


@query(_similar([3], []))
def most_similar(spark, d):
    return rounded(vectors.most_similar(word_vectors(spark, d), [3], [], 10), "score")


@query(_similar([3, 8], [5]))
def analogy(spark, d):
    return rounded(vectors.most_similar(word_vectors(spark, d), [3, 8], [5], 10), "score")


_NEAR = """n{m} AS (SELECT query, word FROM (SELECT a.word AS query, b.word, row_number() OVER (PARTITION BY a.word ORDER BY list_sum(list_transform({span}, lambda i: a.v[i] * b.v[i])) DESC, b.word) AS r FROM e a JOIN e b ON a.word <> b.word) WHERE r <= 20)"""


@query(f"""WITH {_EMB}, {_NEAR.format(m=1, span="range(1, 33)")}, {_NEAR.format(m=2, span="range(33, 65)")}, o AS (SELECT query AS word, count(*) AS overlap FROM n1 JOIN n2 USING (query, word) GROUP BY 1) SELECT e.word, coalesce(overlap, 0) AS overlap FROM e LEFT JOIN o ON o.word = e.word ORDER BY 2, 1 LIMIT 50""")
def neighbour_overlap(spark, d):
    """Two models of the same words: the halves of the vectors."""
    v = word_vectors(spark, d)
    a, b = (v.select("word", F.slice("vector", s, 32).alias("vector"), "n") for s in (1, 33))
    return vectors.most_changed(vectors.neighbour_overlap(a, b, 20), a, b, 50)


@query(f"""WITH {_EMB}, {_NEAR.format(m=1, span="range(1, 33)")}, {_NEAR.format(m=2, span="range(33, 65)")}, o AS (SELECT query AS word, count(*) AS overlap FROM n1 JOIN n2 USING (query, word) GROUP BY 1) SELECT 1 AS period, e.word, coalesce(overlap, 0) AS overlap FROM e LEFT JOIN o ON o.word = e.word""")
def change_per_window(spark, d):
    v = word_vectors(spark, d)
    periods = v.select(F.posexplode(F.array(F.slice("vector", 1, 32), F.slice("vector", 33, 32))).alias("period", "vector"), "word")
    return vectors.change_per_window(periods, 20)


@query(f"""WITH {_EMB}, p AS (SELECT 0 AS period, word, v[1:32] AS v FROM e UNION ALL SELECT 1, word, v[33:64] FROM e), s AS (SELECT a.period, a.word AS query, b.word, list_sum(list_transform(range(1, 33), lambda i: a.v[i] * b.v[i])) AS score FROM p a JOIN p b ON a.period = b.period AND a.word <> b.word WHERE a.word IN (2, 4)),
r AS (SELECT *, row_number() OVER (PARTITION BY period, query ORDER BY score DESC, word) AS rank FROM s WHERE score > 0) SELECT period, query, word, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""")
def neighbours_over_time(spark, d):
    v = word_vectors(spark, d)
    periods = v.select(F.posexplode(F.array(F.slice("vector", 1, 32), F.slice("vector", 33, 32))).alias("period", "vector"), "word")
    return vectors.neighbours_over_time(periods, [2, 4], 5).select("period", "query", "word", "rank")


_VOCABULARY = f"""{TOKENS}, vo AS (SELECT party, word, count(*) AS n FROM (SELECT party, unnest(tokens) AS word FROM texts) GROUP BY ALL HAVING count(*) >= 2)"""


def party_vectors(spark, d) -> DataFrame:
    texts = token_texts(spark, d)
    parties = sorted(r["party"] for r in texts.select("party").distinct().collect())
    return vectors.train_vectors(texts, "party", parties, size=16, min_count=2)


@query(f"WITH {_VOCABULARY} SELECT party, word, n, 16 AS dims FROM vo ORDER BY n DESC, party, word LIMIT 150")
def word2vec_groups(spark, d):
    """Vectors of every party's texts; the most frequent words of all are kept."""
    return vectors.top_vocabulary(party_vectors(spark, d), 150, ["party"]).select("party", "word", "n", F.size("vector").alias("dims"))


@query(f"WITH {_VOCABULARY} SELECT party, word, n, 16 AS dims FROM vo")
def word2vec_groups_all(spark, d):
    """Vectors of every party's texts, whole vocabularies."""
    return party_vectors(spark, d).select("party", "word", "n", F.size("vector").alias("dims"))


@query(f"WITH {_VOCABULARY} SELECT party, word, n, 16 AS dims FROM vo")
def count_vectors_groups(spark, d):
    """Vectors of every party's words by co-occurrence counts, all parties in one pass."""
    found = vectors.train_count_vectors(token_texts(spark, d), "party", size=16, min_count=2)
    return found.select("party", "word", "n", F.size("vector").alias("dims"))


# L: clusters


def cluster_features(spark, d) -> DataFrame:
    return counts.bow_features(windowed(spark, d), top=40)


def _products_sql() -> str:
    features = ORACLE_SQL["bow_features"].replace("round(n / total, 6)", "n / total")
    return f"""WITH f AS ({features}), w AS (SELECT DISTINCT "group", window_no FROM f), p AS (SELECT a."group", a.window_no, b.window_no AS other, sum(a.value * b.value) AS p FROM f a JOIN f b ON a."group" = b."group" AND a.word = b.word GROUP BY ALL)
SELECT a."group", a.window_no, b.window_no AS other, round(coalesce(p, 0), 6) AS product FROM w a JOIN w b ON a."group" = b."group" LEFT JOIN p ON p."group" = a."group" AND p.window_no = a.window_no AND p.other = b.window_no"""


@query(_products_sql())
def window_products(spark, d):
    """Inner products of windows' vectors, from which trees, clusters and correlations are made."""
    found = clusters.pair_products(cluster_features(spark, d))
    pairs = F.inline(F.arrays_zip(F.col("others").alias("other"), F.col("products").alias("product")))
    return rounded(found.select("group", "window_no", pairs), "product")


@query()
def vnc_tree(spark, d):
    return rounded(clusters.vnc(cluster_features(spark, d)), "height")


@query()
def vnc_clusters(spark, d):
    return clusters.vnc_clusters(cluster_features(spark, d), 0.05)


@query()
def cophenetic(spark, d):
    return rounded(clusters.cophenetic(cluster_features(spark, d)), "correlation")


# A: files, written into the session's shared folder and read back


@query(_ce_sql(0) + """ SELECT run, snap_group, test_group, CAST(window_no || '-01-01' AS DATE) AS window_start, uid, round(ce, 6) AS ce FROM ce""", also="results_roundtrip_all")
def results_roundtrip(spark, d):
    """Flat results to the nested JSON view and back."""
    flat = rounded(models.ce_matrix(sampled(spark, d)), "ce").withColumn("window_start", F.make_date("window_no", F.lit(1), F.lit(1)))
    return files.read_results(files.nested_results(flat)).select("run", "snap_group", "test_group", "window_start", "uid", "ce")


@query(f"""WITH {TOKENS} SELECT uid, md5(array_to_string(list_transform(tokens, lambda t: 'P' || len(t)), ' ')) AS pos FROM texts""")
def tagged_tokens(spark, d):
    """Token lines as JSON and back; the parts of speech as a token stream."""
    tag = lambda t: F.struct(t.alias("tok"), t.alias("lemma"), F.concat(F.lit("P"), F.length(t).cast("string")).alias("pos"))
    folder = scratch(spark, "tagged-pos")
    files.write_tagged(token_texts(spark, d).select("uid", F.transform("tokens", tag).alias("tagged")), folder)
    return files.read_tagged(spark, folder).select("uid", F.md5(F.array_join(pos_sequence(F.col("tagged")), " ")).alias("pos"))
