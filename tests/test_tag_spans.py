"""Tags whose first part has no letters a-z against the query's SQL."""

import duckdb

from rostrum.plans import registry


def test_first_part_without_letters_has_no_span(spark, tmp_path):
    w = [f"word{i}" for i in range(1, 71)]
    odd = w[:11] + ["é", "àè"] + w[13:]  # words 12 and 13
    spark.createDataFrame([(2, 0, "user", " ".join(w)), (4, 0, "user", " ".join(odd))], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    want = [(d, t, float(a), float(z)) for d, t, a, z in con.execute(registry.ORACLE_SQL["c06_tag_spans"]).fetchall()]
    got = [tuple(r) for r in registry.QUERIES["c06_tag_spans"](spark, str(tmp_path)).select("debate", "tag", "start_s", "end_s").collect()]
    assert sorted(got) == sorted(want) and {t for _, t, *_ in want} == {2000, 2001, 2002, 4000, 4001}
