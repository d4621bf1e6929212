import random

import numpy as np

import corpus_pipeline
from rostrum.llm import near_copies

from .helpers import documents, frame


def slow_set(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def slow_kept(docs, least=0.8):
    sets = [slow_set(d[1]) for d in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= least * len(a | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    groups = {}
    for i, d in enumerate(docs):
        groups.setdefault(find(i), []).append(1 << 62 if d[0] is None else d[0])
    return sorted(min(g) for g in groups.values())


def edited(rng, text, n):
    w = text.split()
    for i in rng.sample(range(len(w)), n):
        w[i] = f"new{rng.random()}"
    return " ".join(w)


def planted():
    """Groups of copies with up to 10 of 300 words changed, chains of copies of copies, and texts below the bound."""
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(3000)]
    docs = []
    for g in range(40):
        base = " ".join(rng.choice(vocab) for _ in range(300))
        texts = [base]
        for k in range(6):
            texts.append(edited(rng, texts[-1] if g % 2 else base, rng.choice([2, 5, 6, 7, 8, 20])))
        docs += [(100 * g + k, t, "en", "s", None) for k, t in enumerate(texts)]
    rng.shuffle(docs)
    return docs


def test_stage_drops_planted_near_copies(spark):
    docs = planted()
    got = corpus_pipeline.drop_near_duplicates(spark, frame(spark, docs, extra=True), "")
    assert got.columns == frame(spark, docs, extra=True).columns
    assert sorted(r.doc_id for r in got.collect()) == slow_kept(docs)


def test_awkward_documents(spark):
    docs = documents(n=80)
    assert sorted(r.doc_id for r in near_copies.keep_one(frame(spark, docs, extra=True)).collect()) == slow_kept(docs)
    assert near_copies.keep_one(frame(spark, [])).count() == 0
    same = [(None, "a b c", None, None, None), (7, "A b  c", None, None, None), (7, "d e f", None, None, None), (7, "d e f", None, None, None)]
    assert sorted(r.text for r in near_copies.keep_one(frame(spark, same)).collect()) == ["A b  c", "d e f"]


def test_cross_links_join_what_all_pairs_join():
    rng = random.Random(1)
    sets = []
    for _ in range(60):
        base = set(rng.sample(range(10**6), 40)) if rng.random() < 0.2 or not sets else set(rng.choice(sets).tolist())
        for x in rng.sample(sorted(base), rng.randint(0, 6)):
            base.remove(x)
            base.add(rng.randrange(10**6))
        sets.append(np.array(sorted(base), np.uint64))
    edges = near_copies.cross_links(sets, np.arange(60), 0.8)
    assert all(near_copies.similar(sets[i], sets[j], 0.8) for i, j in edges)
    pairs = [(i, j) for i in range(60) for j in range(i) if near_copies.similar(sets[i], sets[j], 0.8)]

    def labels(links):
        fp = list(range(60))
        for _ in range(60):
            for i, j in links:
                fp[i] = fp[j] = min(fp[i], fp[j])
        return fp

    assert labels(edges) == labels(pairs)
