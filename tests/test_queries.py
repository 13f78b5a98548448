"""Registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = ["corpus_party_at_date", "member_resolution", "conversation_merge", "time_windows", "corpus_stats", "keyness_ll", "group_keywords", "member_split_balanced", "ce_matrix", "kld_matrix", "collocates_mi", "nearest_neighbours", "results_roundtrip"]

NAMES += ["archive_files", "transcript_elements", "archives_to_contributions", "debates_json", "corpus_tables", "division_csv", "key_dates", "member_groups", "terms_topic", "tagged_token_lines", "keyword_files", "stats_csv", "constituency_leave"]
NAMES += ["assembled_corpus", "members_left_out", "files_in_period", "groups_by_value", "parsed_dates", "debate_file_names", "token_trigrams", "lean_labels", "member_intervals", "windows_that_differ", "clean_text", "tokenise", "quantile_split", "events_in_windows", "snapshot_asof", "keyword_rank_diff"]
NAMES += ["fuzzy_match", "fuzzy_match_named", "display_name", "bigram_model", "ce_fluctuation", "kld_fluctuation", "snapshot_cross_entropy", "ace_mean_std", "ace_chunks_job", "ace_grid_job", "ace_questions_job", "ace_methods_job", "median_per_member", "window_keywords", "collocates_in_windows", "day_window_counts", "fluct_ac1", "neighbour_overlap", "word2vec_groups_all", "count_vectors_groups", "tagged_tokens"]

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def plain(value):
    return round(float(value), 4) if isinstance(value, float) or type(value).__name__ == "Decimal" else (value.isoformat()[:10] if hasattr(value, "isoformat") else value)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    df = __spark_entry__.queries()[name](spark, DIR)
    cursor = db.execute(__spark_entry__.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(str([plain(v) for v in r]) for r in cursor.fetchall())
    assert sorted(str([plain(r[c]) for c in names]) for r in df.collect()) == want


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["group", "word", "c1", "c2", "lr"]
