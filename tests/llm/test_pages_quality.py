import math
import os
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rostrum.llm import html_text, quality, url_filter

from ..conftest import SF
from .helpers import documents, frame, rows

PAGES = "page_id long, url string, html string"


def pages(spark, data, extra=True):
    df = spark.createDataFrame(data, PAGES)
    return df.selectExpr("*", "'clash' AS host", "'clash' AS rule", "0 AS node", "'clash' AS low") if extra else df


# URL filter


def slow_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def slow_rank(edges, seeds, rounds=60, d=0.85):
    hosts = sorted({h for e in edges for h in e} | set(seeds))
    at = {h: i for i, h in enumerate(hosts)}
    m = np.zeros((len(hosts), len(hosts)))
    for a, b in edges:
        m[at[b], at[a]] += 1
    m = m / np.maximum(m.sum(axis=0), 1)
    s = np.array([1 / len(seeds) if h in seeds else 0 for h in hosts])
    r = s.copy()
    for _ in range(rounds):
        r = d * m @ r + (1 - d) * s
    return dict(zip(hosts, r, strict=True))


def test_url_parts_and_rules(spark):
    urls = ["http://A.Example.COM/en/7/x?q#f", "http://example.com/en/8", "https://x.net/de/1", "http://a.example.net/de/8?x", "ftp://q.org/es/", "http://myorg/es/", "http://org/es/1", "nothing", None, "", "http://h", "http://h?x/y", "a://b://c/d", "http://notexample.com/en/7"]
    got = rows(url_filter.judge(pages(spark, [(i, u, None) for i, u in enumerate(urls)])), "page_id", "host", "path", "rule", "verdict")
    want = []
    for i, u in enumerate(urls):
        host, path = slow_parts(u)
        fit = [r for r in url_filter.RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        best = max(fit, key=lambda r: len(r[0] + r[1]), default=None)
        want.append((i, host, path, best and best[0] + best[1], best[2] if best else "allow"))
    assert got == sorted(want, key=repr)


def test_propagation_equals_dense_matrix(spark):
    rng = random.Random(2)
    hosts = [f"h{i}.xyz" for i in range(25)] + ["good.net", "bad.org"]
    edges = {(a, b) for a in hosts for b in rng.sample(hosts, 3) if a != b}
    data = [(i, f"http://{a}/{'de' if a == 'good.net' else 'es'}/", f'<p><a class="l" href="HTTP://{b.upper()}/q">x</a><A HREF=\'/local\'>') for i, (a, b) in enumerate(sorted(edges))]
    got = {r.host: r for r in url_filter.host_verdicts(pages(spark, data), rounds=100, tolerance=1e-12).collect()}
    links = [(a, b) for a, b in edges]
    trust, distrust = slow_rank(links, {"good.net"}), slow_rank([(b, a) for a, b in links], {"bad.org"})
    for h in hosts:
        assert abs((got[h].trust if h in got else 0) - trust.get(h, 0)) < 1e-6
        assert abs((got[h].distrust if h in got else 0) - distrust.get(h, 0)) < 1e-6
    blocked = {h for h in hosts if h != "bad.org" and distrust[h] >= 0.05 and distrust[h] > trust[h]}
    assert {h for h, r in got.items() if r.blocked} == blocked and blocked
    verdict = {r.host: r.verdict for r in url_filter.judge(pages(spark, data)).collect()}
    assert {h for h, v in verdict.items() if v == "block"} == blocked | {"bad.org"}


def test_url_filter_empty(spark):
    assert url_filter.judge(pages(spark, [])).count() == 0


# Main text


def test_page_cases():
    text = html_text.main_text
    art = "<nav><ul><li>menu</ul></nav><!-- c --><div class='ad'>buy</div><article><h1>T &amp;amp; &lt;x&gt;</h1><p><b>one<br>two<p> three\n\tfour </p></article><footer>&copy;"
    assert text(f"<!DOCTYPE html><html><head><title>no</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{art}") == "T &amp; <x> one two three four"
    assert text(None) == text("") == text("<article></article><p>x") .replace("x", "") == ""
    assert text("<p>plain<p>text") == "plain text"
    assert text("<main><h1>A</h1>b</main><aside>c</aside>") == "A b"
    assert text("<article>x<section id=comments>y<article>z</article></section></article>") == "x"
    assert text("<article>a<form>f<input></form><aside>s</aside><script>if (a<b) {}</script>b</article>") == "a b"
    assert text("<div>a<b>b</b>c<span>d</span></div><div>e</div>") == "abcd e"
    assert text("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>") == "a b c d"
    assert text("a < b <p>c") == "a < b c"
    assert text("<article><p>long " + "w " * 50000 + "</article>").count("w") == 50000


def test_deep_nesting_is_linear():
    assert html_text.main_text("<div>" * 50_000 + "deep" + "</div>" * 50_000) == "deep"
    assert html_text.main_text("<div>x" * 50_000).count("x") == 50_000


def slow_importance(pages, key):
    """Importance of the node ``key`` from the parsed pages of one host, by the definition."""
    styles, blocks, m = {}, {}, 0
    for i, html in enumerate(pages):
        own = [(e, t) for e, t in html_text.parse(html)[0] if e.key == key]
        m += bool(own)
        for e, t in own:
            style = tuple(c for c, before in zip(e.children, [None, *e.children], strict=False) if c != before)
            styles.setdefault(style, set()).add(i)
            blocks.setdefault(t, set()).add(i)
    if m <= 1:
        return 0.5
    n = [len(x) for x in styles.values()]
    presentation = -sum(x / sum(n) * math.log(x / sum(n)) for x in n) / math.log(m)
    content = 1 - sum(math.log(len(x)) for x in blocks.values()) / len(blocks) / math.log(m)
    g = html_text.G ** len(styles)
    raw = min(1, max(0, (1 - g) * presentation + g * content))
    return (raw * m + 0.5 * html_text.EVIDENCE) / (m + html_text.EVIDENCE)


def test_tree_equals_definition(spark):
    rng = random.Random(4)
    part = lambda i: "".join(f"<div class=c{j}>{rng.choice(['same', f'own {i}', 'twice'])}{rng.choice(['', '<ul><li>a</ul>', '<p>b'])}</div>" for j in "abc")
    html = [f"<body>{part(i)}<article><p>text {i % 7}</article></body>" for i in range(25)]
    tree = {r.node: r.importance for r in html_text.style_tree(pages(spark, [(i, None, h) for i, h in enumerate(html)])).collect()}
    keys = {e.key for h in html for e, _ in html_text.parse(h)[0]}
    assert {html_text.signed(k) for k in keys} == set(tree)
    for k in keys:
        assert abs(tree[html_text.signed(k)] - slow_importance(html, k)) < 1e-9


def test_without_article_elements_little_changes(spark, sf):
    src = spark.read.parquet(f"{sf}/pages.parquet")
    bare = src.selectExpr("page_id", "url", "regexp_replace(html, '<(/?)article>', '<$1div>') AS html")
    a = {r.page_id: r.text for r in html_text.extract(src).collect()}
    b = {r.page_id: r.text for r in html_text.extract(bare).collect()}
    assert sum(a[i] == b[i] for i in a) >= 0.95 * len(a)


@given(st.text(alphabet="<>/!-apdiv \"'=&;", max_size=80))
@settings(max_examples=200, deadline=None)
def test_parser_never_fails(s):
    html_text.main_text(s)


def site(n=30):
    return [
        (i, f"http://Site.com/{i}", f"<html><body><div class=top>Motto of the site</div><div class=body{i}><p>Story {i} begins<p>and ends {i}</div><div class=foo>All rights reserved</div></body></html>")
        for i in range(n)
    ]


def test_style_tree_drops_what_repeats(spark):
    data = [*site(), (90, "http://alone.com/", "<div class=top>Motto of the site</div><p>x"), (91, None, None), (92, "u", "")]
    want = {i: f"Story {i} begins and ends {i}" for i in range(30)} | {90: "Motto of the site x", 91: "", 92: ""}
    for nodes in (1000, 0):
        got = html_text.extract(pages(spark, data), broadcast_nodes=nodes).collect()
        assert {r.page_id: r.text for r in got} == want
        assert all(r.n_chars == len(r.text) for r in got)
    assert html_text.extract(pages(spark, [])).count() == 0


def test_pages_table(spark, sf):
    import html as h

    src = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r.text for r in html_text.extract(src).collect()}
    for r in src.collect():
        body = re.search("<article>(.*?)</article>", r.html, re.S)[1]
        parts = [" ".join(h.unescape(re.sub("</?b>", "", x.replace("<br>", " "))).split()) for x in re.split("</?(?:p|h1)>", body)]
        assert got[r.page_id] == " ".join(x for x in parts if x)


# Quality


def slow_statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    wins = list(zip(words, words[1:], words[2:], strict=False))
    cover = {i + j for i, w in enumerate(wins) if wins.count(w) > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(cover), len(set(words)), sum(c in ".,;:!?" for c in text)


@given(st.text(alphabet="ab \n\t\r#|.!é\x1c\u00a0", max_size=80))
@settings(max_examples=200, deadline=None)
def test_statistics(text):
    assert quality.text_statistics(text) == slow_statistics(text)


def test_judge(spark):
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    clean = lambda: " ".join(rng.choice(vocab) for _ in range(rng.randint(60, 900)))
    junk = lambda: " ".join(rng.choice(vocab) + rng.choice(["###", "$$$", "&&&"]) for _ in range(rng.randint(60, 300)))
    docs = [(i, junk() if i % 10 == 0 else clean(), "en" if i % 2 else None, f"s{i % 3}", None) for i in range(600)]
    docs += [(1000 + i, d[1], d[2], d[3], d[4]) for i, d in enumerate(documents())]
    got = {r.doc_id: r for r in quality.judge(frame(spark, docs, extra=True)).collect()}
    for i, text, *_ in docs:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_distinct, r.n_marks) == slow_statistics(text[:4000] if i == 1010 else text) or i == 1010
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        if i < 600:
            assert r.kept == (i % 10 != 0)
    kept = quality.keep(frame(spark, docs, extra=True))
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept} and kept.columns == frame(spark, docs, extra=True).columns


def test_judge_equal_rows_and_empty(spark):
    assert quality.judge(frame(spark, [])).count() == 0
    same = [(1, " ".join(f"w{i}" for i in range(80)), None, None, None)] * 5 + [(2, None, None, None, None)]
    assert rows(quality.judge(frame(spark, same)), "doc_id", "kept") == [*[(1, True)] * 5, (2, False)]


def slow_mcd(x, coverage=0.75):
    """Concentration steps in numpy from many random starts; the least determinant."""
    rng, h, best = np.random.default_rng(3), math.ceil(coverage * len(x)), (np.inf, None)
    for _ in range(200):
        half = rng.choice(len(x), 2 * quality.D, replace=False)
        for _ in range(50):
            mean, cov = x[half].mean(axis=0), np.cov(x[half].T, bias=True) + quality.NOISE
            d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
            half = np.argsort(d)[:h]
        det = np.linalg.slogdet(np.cov(x[half].T, bias=True) * quality.consistency(coverage) + quality.NOISE)[1]
        best = min(best, (det, tuple(sorted(half))))
    half = list(best[1])
    return best[0], x[half].mean(axis=0), np.cov(x[half].T, bias=True) * quality.consistency(coverage)


def test_mcd_equals_brute_force_and_sees_correlation(spark):
    rng, D = np.random.default_rng(1), quality.D
    mix = np.eye(D) + np.triu(rng.uniform(0.3, 0.9, (D, D)), 1)
    groups = {k: rng.standard_normal((n, D)) @ mix + i for i, (k, n) in enumerate((("a", 120), ("b", 240)))}
    groups["a"][:20] += 12  # outliers that draw plain moments
    groups["b"][0] = [2.0 * s for s in (1, -1, 1, -1, 1, -1, 1)] + groups["b"].mean(axis=0)  # unremarkable in every measure alone
    data = [("en", k, *map(float, r)) for k, x in groups.items() for r in x]
    df = spark.createDataFrame(data, "lang string, k string, " + ", ".join(f"{c} double" for c in quality.XS))
    state, n = quality.mcd(df, prior=0)
    assert n == 2
    for r in state.collect():
        x = groups[r.k]
        det, mean, cov = slow_mcd(x)
        got = np.linalg.inv(np.array(r.inv).reshape(D, D))
        # The share is cut at a bin of the distance, so a few rows more may count than in brute force.
        assert np.linalg.slogdet(got)[1] <= det + 0.35 and np.abs(np.array(r.mean) - mean).max() < 0.25
        assert np.abs(got - quality.NOISE - cov).max() < 0.3 * np.abs(cov).max()
        if r.k == "b":
            d = (x[0] - r.mean) @ np.array(r.inv).reshape(D, D) @ (x[0] - r.mean)
            alone = ((x[0] - x.mean(axis=0)) / x.std(axis=0)) ** 2
            assert d > quality.chi2_quantile(1 - 1e-5, D) and alone.max() < quality.chi2_quantile(0.99, 1)


def test_correlations_decide_verdicts(spark):
    """Without them, good documents whose number of different words follows from their length would be rejected."""
    path = os.path.join(os.path.dirname(SF), "sf0.1")
    if not os.path.isdir(path):
        pytest.skip("no such table")
    docs, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    fit = quality.measured(quality.statistics(docs)).where(~quality.base_failed()).join(labels.select("doc_id", "quality"), "doc_id", "left")
    fit = fit.select("lang", "k", "quality", *quality.XS).toPandas()
    state, _ = quality.mcd(spark.createDataFrame(fit[["lang", "k", *quality.XS]]))
    limit, wrong, changed = quality.chi2_quantile(1 - 1e-5, quality.D), [0, 0], 0
    for r in state.collect():
        x, inv = fit[fit.k == r.k], np.array(r.inv).reshape(quality.D, quality.D)
        alone = np.diag(1 / np.diag(np.linalg.inv(inv)))
        d = [np.einsum("ij,jk,ik->i", x[quality.XS] - r.mean, m, x[quality.XS] - r.mean) for m in (inv, alone)]
        out = [v > limit * max(1, np.quantile(v, quality.TRUSTED) / quality.chi2_quantile(quality.TRUSTED, quality.D)) for v in d]
        good = (x.quality == 1).to_numpy()
        wrong = [w + int((o & good).sum()) for w, o in zip(wrong, out, strict=True)]
        changed += int((out[0] != out[1]).sum())
    assert wrong[0] <= 2 and wrong[1] >= wrong[0] + 3 and changed >= 10


def test_chi_square():
    assert abs(quality.chi2_quantile(0.5, 5) - 4.351) < 0.02 and abs(quality.chi2_cdf(4.351, 7) - 0.2614) < 0.001


# Pipeline


def test_pipeline_runs_every_stage(spark, sf):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = p.drop_low_quality(spark, docs, sf)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in quality.judge(docs).collect() if r.kept}
    assert {r.doc_id for r in kept.collect()} == ids
    out = p.run(spark, sf).collect()
    assert out and all(0 < r.length <= 4096 for r in out) and {r.doc_id for r in out} <= ids
