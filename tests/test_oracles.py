"""Queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from loomtext.plans import html_queries

SF = "/root/testdata/sf0.001"
SOME = ["c2_sentence_end_chunks", "c3_fixed_chunks", "c5_boundary_chunks", "c8_separators_chunks", "f1_semantic", "f7_two_hops", "f8_dispatch", "z6_methods", "x6_selective", "e5_cross_lingual", "e6_pairs", "z21_nearest_patterns", "a25_stop_rule", "a2_top_values", "s2_loaded", "s17_listed", "s19_generated", "t1_clean", "t7_keywords", "t12_synonyms", "t15_sub_queries", "c1_word_chunks", "c7_sentence_chunks", "c11_structure", "p1_pii", "e2_hallucination", "v4_distances", "v7_top_k", "v15_filtered_knn", "v17_faceted", "v18_two_categories", "k3_tf_idf_search", "k4_bm25_search", "f3_weighted_minmax", "f4_rrf", "rr2_diversity", "x1_context", "a2_profile", "a10_free_hours", "a24_bids", "w1_sessions", "w3_message_window", "m1_titles", "m4_tables", "m5_nested", "m6_cell_parts", "m11_page_tree", "a19_intents", "a22_normalized", "a23_search_words", "a25_rubric", "a25_router", "e3_judged", "z10_aliases", "z12_summaries", "s4_json_strings", "s10_session_json", "s13_changes", "s14_batches", "s18_directories", "v1_hashed_vectors", "z2_typed", "z4_json_content", "z8_rag_query", "u3_tools", "u1_chunk_function", "w6_index_update", "k2_frequencies", "w4_cache", "w4_cache_stream", "w1_registry", "x7_summaries", "v5_extremes", "v11_interpretation", "v13_mmr", "v14_redundancy", "s8_feedback", "s9_files", "s11_samples", "s12_collections", "u2_own_vectors", "a1_keyword_rows", "a3_cross_table", "e6_training_pairs"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return c


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    got = sorted((tuple(plain(v) for v in r) for r in df.select(columns).collect()), key=repr)
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cur.fetchall()), key=repr)
    assert got == want


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_titles_equal_sql_on_odd_pages(spark):
    """Escapes without their semicolon stay, other escapes too; spaces go from the ends alone; a null page has no title."""
    inner = ["a &amp; b", "cut &amp", "&amp;lt; &lt;&gt; &quot;q&quot;", "&copy; &#39;x&#39; &nbsp;", "  two  words  ", "line\nline\t", ""]
    html = [*(f"<html><head><title>{x}</title></head><body><p id='title-text'>other</p></body></html>" for x in inner), "<TITLE>upper</TITLE><h1>head</h1>", "<title>a<b>c</title>", "<p>none</p>", "", None]
    rows = list(enumerate(html))
    got = html_queries.html.titles(spark.createDataFrame(rows, "page_id long, html string")).select("page_id", "title").collect()
    c = duckdb.connect()
    c.execute("CREATE TABLE pages (page_id BIGINT, html VARCHAR)")
    c.executemany("INSERT INTO pages VALUES (?, ?)", rows)
    assert sorted(map(tuple, got)) == sorted(c.execute(entry.oracle_sql()["m1_titles"]).fetchall())
