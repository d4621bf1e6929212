import re
from collections import Counter
from itertools import permutations

from rostrum.llm import filter_audit

from .helpers import documents, frame

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
COLS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def slow(docs, labels):
    """{(part, order, step): counts} by applying every order to every document."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    first = {}
    for d, text, *_ in docs:
        if d is not None:
            first[text or ""] = min(first.get(text or "", d), d)
    out, shapley = {}, Counter()
    for d, text, _, source, _ in docs:
        text = text or ""
        w = WORDS.findall(text)
        fails = set()
        if len(w) < 50:
            fails.add("A")
        if 100 * len(set(w)) < 65 * len(w):
            fails.add("B")
        if 100 * len(re.findall("[A-Z]", text)) > 5 * len(text):
            fails.add("C")
        if re.search(r"[#$%&*|]", text):
            fails.add("D")
        if d is not None and first[text] < d:
            fails.add("E")
        for order in map("".join, permutations("ABCDE")):
            alive = True
            for step, x in enumerate(order, 1):
                c = out.setdefault((source or "", order, step), Counter())
                if alive and x in fails:
                    alive = False
                    c["removed"] += 1
                    c["good_lost"] += d in good
                    c["toxic_lost"] += d in toxic
                    shapley[source or "", x] += 1
                elif x in fails:
                    c["redundant"] += 1
                c["kept"] += alive
                c["unique_fails"] += fails == {x}
    return {k: (*(c[x] for x in COLS), shapley[k[0], k[1][k[2] - 1]]) for k, c in out.items()}


def measured(df):
    got = {(r.part, r.filter_order, r.step): (*(r[x] for x in COLS), r.shapley) for r in df.collect()}
    assert df.count() == len(got)
    return got


LABELS = "doc_id long, quality int, toxic int"


def data():
    rows = documents()
    rows += [(200 + i, ("Some WORDS here " * 20 + "& more") if i % 2 else "plain text " + "w%d " % i * 30, "en", "s1", 1) for i in range(12)]
    rows += [(300, rows[15][1], None, "", 1), (300, rows[15][1], None, None, 1), (None, rows[15][1], "en", "s1", 1), (None, None, None, None, None)]
    labels = [(i, i % 2, (i // 2) % 2) for i in range(0, 60, 3)] + [(3, 1, 0), (3, None, None), (None, 1, 1), (200, 1, 1), (300, 1, None)]
    return rows, labels


def test_equals_replay_of_every_order(spark):
    rows, labels = data()
    got = measured(filter_audit.audit(frame(spark, rows, extra=True), spark.createDataFrame(labels, LABELS)))
    assert got == slow(rows, labels)
    assert all(any(v[i] for v in got.values()) for i in range(len(COLS) + 1))


def test_hot_text_and_hot_id_go_by_broadcast(spark, monkeypatch):
    """One text and one id hold most rows; with two as the bound of keys both ways of the join are used."""
    rows, labels = data()
    rows += [(1000 + i, "the same text", "en", "hot", 1) for i in range(300)] + [(7, "repeated id %d" % i, "en", "hot", 1) for i in range(300)]
    labels.append((7, 1, 1))
    want = slow(rows, labels)
    flags = filter_audit.flag_documents
    monkeypatch.setattr(filter_audit, "SHARE", 3)
    assert measured(filter_audit.replay(flags(frame(spark, rows), spark.createDataFrame(labels, LABELS)))) == want


def test_empty_table_and_no_labels(spark):
    none = spark.createDataFrame([], LABELS)
    assert filter_audit.audit(frame(spark, []), none).count() == 0
    one = measured(filter_audit.audit(frame(spark, [(1, None, None, None, None)]), none))
    assert len(one) == 600 and one == slow([(1, None, None, None, None)], [])


def test_plan_broadcasts_orders_and_combines_before_the_exchange(spark):
    plan = filter_audit.audit(frame(spark), spark.createDataFrame([(1, 1, 1)], LABELS))._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and "Python" not in plan and "CartesianProduct" not in plan


def test_query_equals_sql(spark, sf):
    from rostrum.llm import queries

    from ..compare import compare, connect

    assert compare(spark, connect(sf), sf, queries.QUERIES["op12_filter_audit"], queries.ORACLE_SQL["op12_filter_audit"]) is None
