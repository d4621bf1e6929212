import os

import duckdb

from rostrum.llm import mixing

from .helpers import documents, frame, rows

COLS = ("doc_id", "size", "source_size", "target", "taken")


def oracle(spark, docs, tmp_path):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    return sorted(con.sql(mixing.ORACLE).fetchall(), key=repr)


def test_totals_equal_sql(spark, tmp_path):
    want = oracle(spark, documents(), tmp_path)
    assert rows(mixing.mix_totals(frame(spark, extra=True)), *COLS) == want
    # Many buckets give the same as one.
    plan = mixing.mix_plan(frame(spark), rows_per_bucket=2)
    taken = sum(mixing.copies_taken()[e] for e in range(3))
    assert rows(plan.withColumn("taken", taken.cast("long")), *COLS) == want


def test_targets_and_bounds(spark):
    docs = [(i, "w " * (1 + i % 5), None, f"s{i % 7}" if i % 3 else "big", None) for i in range(300)]
    got = mixing.mix_totals(frame(spark, docs)).collect()
    total = sum(r["size"] for r in got)
    taken = {}
    src = {d[0]: d[3] for d in docs}
    for r in got:
        assert 0 <= r.taken <= 3 * r["size"] and r.target <= 3 * r.source_size
        taken.setdefault((src[r.doc_id], r.target), []).append(r.taken)
    assert abs(sum(t for _, t in taken) - total) < 1e-6
    assert all(sum(x) == int(t) for (_, t), x in taken.items())


def test_mix_rows(spark):
    df = frame(spark)
    totals = {r.doc_id: r.taken for r in mixing.mix_totals(df).collect()}
    out = mixing.mix(df)
    assert out.columns == df.columns
    got = {}
    for r in out.select("doc_id", "text", "n_chars").collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len((r.text or "").split())
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in totals.items() if v}
    assert {2, 4, 8} <= set(got)  # documents without words stay


def test_cut_at_the_budget_equals_closed_form(spark):
    docs = [(i % 40 if i % 7 else None, "w " * (i * i % 23), None, f"s{i % 5}" if i % 3 else "big", None) for i in range(500)]
    plan = mixing.mix_plan(frame(spark, docs), rows_per_bucket=20)
    cols = ("doc_id", "size", "position", "source_size", "copies")
    want = rows(plan.withColumn("copies", mixing.copies_taken()), *cols)
    for ranges in (1, 3, 1 << 12):
        last = mixing.end_of_mix(plan, ranges=ranges).first()["last"]
        assert 0.99 < last <= 1
    assert rows(mixing.mixed(plan), *cols) == want


def test_edge_tables(spark):
    assert mixing.mix_totals(frame(spark, [])).count() == 0
    one = [(1, None, None, None, None)]
    assert rows(mixing.mix_totals(frame(spark, one)), *COLS) == [(1, 0, 0, 0.0, 0)]
    assert mixing.mix(frame(spark, one)).count() == 1
    same = [(1, "a b", None, "x", None)] * 3
    assert sum(r.taken for r in mixing.mix_totals(frame(spark, same)).collect()) == 6


def test_native(spark):
    plan = mixing.mix_totals(frame(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan, os.linesep + plan
