"""Quality rules: base rules on word statistics, then robust multivariate outliers per group.

``statistics`` counts over whole texts.  ``judge`` transforms the counts to the measures of
:data:`MEASURES` and fits a minimum-covariance-determinant estimate for each language and source.

*Fit.* Three deterministic starts (medians with scaled median deviations, the spatial sign
covariance about the medians, plain moments) are each improved by concentration steps: mean and
covariance of the ``coverage`` of the group that is nearest by the last estimate, until the
determinant no longer falls.  The start that ends with the least determinant is kept.

*Regularity.* Rates of symbols, repeats and equal lines are zero in most documents, so the nearest
documents often agree on them exactly; there the noise of counting (:data:`MEASURES`), which is added to the
diagonal as by the regularised estimate of Boudt and others, sets the scale.  Length, word length, different words
and marks vary everywhere: there the fitted variances and correlations decide (how many different words a text
should have follows from its length).  Every group's estimate is drawn to the pooled one of its
language with the weight of ``prior`` documents, which fades as the group grows; no size is a switch.

*Verdict.* A document is rejected if its squared Mahalanobis distance exceeds the chi-square quantile
``tail``, widened where the nearest four fifths of the group already spread wider than a normal group's.

The fit runs on every document that passes the base rules.  A step is one aggregation: moments per group
and bin of the logarithm of the distance, at most about 2 000 bins a group, so a group of any size costs
partial sums and no task ever holds a group's rows.

Edge cases: a null or empty text has no words and fails the base rules; a null language or source
is a value of its own; a group of equal rows has the noise alone, so nothing divides by zero; a group
without a row that passes the base rules has no estimate and rejects nothing more; an empty table
gives no rows; repeated rows count as often as they occur; other columns are not read (``keep``
passes them on).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..catalog import spread
from ..session import drop_scratch, scratch

SYMBOLS = re.compile(r"[#*$%&|<>]")
MARKS = re.compile(r"[.,;:!?]")
#: Measures of the counts (a hundred words of five characters, all different, with a mark to each ten are added where a
#: spread would otherwise grow as texts get shorter), each with the deviation that counting noise alone may give a document.
MEASURES = {
    "ln(n_words + 100)": 0.05,
    "(word_chars + 500) / (n_words + 100)": 0.05,
    "ln(0.1 + n_symbols / n_words)": 0.2,
    "ln(0.1 + 10 * n_dup_lines / n_words)": 0.3,
    "ln(0.1 + n_repeat_words / n_words)": 0.3,
    "ln(n_distinct + 100)": 0.02,
    "ln((n_marks + 10) / (n_words + 100))": 0.1,
}
D = len(MEASURES)
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_distinct long, n_marks long"


def text_statistics(text: str | None) -> tuple[int, ...]:
    """The counts of :data:`STATS` for one whole text."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()  # ASCII white space: exactly the word separators
    n = len(words)
    chars = len(text) - sum(map(text.count, " \t\n\r\x0b\x0c"))
    symbols = len(SYMBOLS.findall(text))
    dup = 0
    if "\n" in text:
        lines = [x for x in text.split("\n") if x.strip(" \t\r\x0b\x0c")]
        dup = len(lines) - len(set(lines))
    repeat = 0
    if n > 3:
        wins = list(zip(words, words[1:], words[2:], strict=False))
        if len(set(wins)) < len(wins):
            often = {w for w, k in Counter(wins).items() if k > 1}
            last = -1  # the last word counted
            for i, w in enumerate(wins):
                if w in often:
                    repeat += i + 3 - max(i, last + 1)
                    last = i + 2
    return n, chars, symbols, dup, repeat, len(set(words)), len(MARKS.findall(text))


def statistics(docs: DataFrame, whole: bool = False) -> DataFrame:
    """doc_id, lang, source and the counts, for whole texts; with ``whole`` also ``rest``, the row itself."""

    def run(batches):
        for b in batches:
            text = b.column("rest").field("text") if whole else b.column("text")
            cols = list(zip(*map(text_statistics, text.to_pylist()), strict=True)) or [[]] * D
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("lang"), b.column("source"), *(pa.array(c, pa.int64()) for c in cols), *([b.column("rest")] if whole else [])],
                names=["doc_id", "lang", "source", *(x.split()[0] for x in STATS.split(", ")), *(["rest"] if whole else [])],
            )

    docs = spread(docs)
    kind = dict(docs.dtypes)["doc_id"]
    row = F.struct(*[docs[c] for c in docs.columns]).alias("rest") if whole else F.col("text")
    cols = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), row)
    result = StructType.fromDDL(f"doc_id {kind}, lang string, source string, {STATS}")
    return cols.mapInArrow(run, result.add(cols.schema["rest"]) if whole else result)


def base_failed() -> F.Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def chi2_quantile(p: float, k: int) -> float:
    """Wilson and Hilferty's approximation."""
    z = NormalDist().inv_cdf(p)
    return k * (1 - 2 / (9 * k) + z * math.sqrt(2 / (9 * k))) ** 3


def chi2_cdf(x: float, k: int) -> float:
    a, x = k / 2, x / 2
    term = total = math.exp(-x + a * math.log(x) - math.lgamma(a + 1))
    for i in range(1, 500):
        term *= x / (a + i)
        total += term
    return total


def _distance() -> F.Column:
    """Squared Mahalanobis distance of the columns x0.. from the group's estimate (mean, inv)."""
    terms = [f"{1 if i == j else 2} * (x{i} - mean[{i}]) * (x{j} - mean[{j}]) * inv[{i * D + j}]" for i, j in HALF]
    return F.expr(" + ".join(terms))


NOISE = np.diag(np.array(list(MEASURES.values())) ** 2)
XS = [f"x{i}" for i in range(D)]
HALF = [(i, j) for i in range(D) for j in range(i, D)]
#: Share of a group taken as free of outliers when its tail is compared with a normal one.
TRUSTED = 0.8
#: Bins to a doubling of the squared distance.
BINS = 32
STATE = "lang string, k string, start int, total long, n long, mean array<double>, cov array<double>, inv array<double>, logdet double, moved boolean"


def consistency(share: float) -> float:
    """Factor from the covariance of the nearest ``share`` of a normal group to that of all of it."""
    return share / chi2_cdf(chi2_quantile(share, D), D + 2) if share < 0.999 else 1.0


def _state_row(lang, k, start, total, n, mean, cov, before: float | None) -> tuple:
    full = cov + NOISE
    logdet = float(np.linalg.slogdet(full)[1])
    moved = before is None or logdet < before - 1e-7
    return lang, k, start, total, n, mean.tolist(), cov.ravel().tolist(), np.linalg.inv(full).ravel().tolist(), logdet, moved


def _state_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), *[pa.list_(pa.float64())] * 3, pa.float64(), pa.bool_()]
    cols = list(zip(*rows, strict=True)) or [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in STATE.split(", ")])


def _moments() -> list[F.Column]:
    """Sums, and sums of products as the upper half of a square."""
    s = ", ".join(f"sum({x})" for x in XS)
    return [F.expr(f"array({s})").alias("s"), F.expr("array(" + ", ".join(f"sum({XS[i]} * {XS[j]})" for i, j in HALF) + ")").alias("c")]


def _square(half: np.ndarray) -> np.ndarray:
    """The symmetric matrix whose upper half this is."""
    out = np.zeros((D, D))
    for v, (i, j) in zip(half, HALF, strict=True):
        out[i, j] = out[j, i] = v
    return out


#: Estimates are about 500 bytes a row; up to so many they are broadcast (10 MB), else joined by key.
BROADCAST_GROUPS = 20_000


def _per_group(df: DataFrame, groups: int) -> DataFrame:
    return F.broadcast(df) if groups <= BROADCAST_GROUPS else df


def starts(rows: DataFrame) -> tuple[DataFrame, int]:
    """Three first estimates per group of ``rows`` (lang, k, x0, x1, ..), and the number of groups."""
    mid = scratch(rows.groupBy("lang", "k").agg(F.count("*").alias("total"), F.array(*[F.percentile_approx(x, 0.5, 1000) for x in XS]).alias("mid")), "mcd")
    groups = mid.count()
    near = rows.join(_per_group(mid.select("k", "total", "mid"), groups), "k")
    dev = [f"(x{i} - mid[{i}])" for i in range(D)]
    unit = [f"if(size > 0, {d} / size, 0d)" for d in dev]
    seen = near.withColumn("size", F.expr("sqrt(" + " + ".join(f"{d} * {d}" for d in dev) + ")")).groupBy("lang", "k").agg(
        F.first("total").alias("total"), F.first("mid").alias("mid"), *_moments(),
        F.expr("array(" + ", ".join(f"percentile_approx(abs{d}, 0.5, 1000)" for d in dev) + ")").alias("mad"),
        F.percentile_approx("size", 0.5, 1000).alias("size"),
        F.expr("array(" + ", ".join(f"sum({unit[i]} * {unit[j]})" for i, j in HALF) + ")").alias("u"),
    )

    def run(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                n, mid, mean = r["total"], np.array(r["mid"]), np.array(r["s"]) / r["total"]
                plain = _square(r["c"]) / n - np.outer(mean, mean)
                signs = _square(r["u"]) / n * D * r["size"] ** 2
                for i, (m, c) in enumerate(((mid, np.diag((1.4826 * np.array(r["mad"])) ** 2)), (mid, signs), (mean, plain))):
                    out.append(_state_row(r["lang"], r["k"], i, n, n, m, c, None))
            yield _state_batch(out)

    state = scratch(seen.mapInArrow(run, STATE), "mcd")
    drop_scratch(mid)
    return state, groups


def concentrate(rows: DataFrame, state: DataFrame, groups: int, coverage: float) -> DataFrame:
    """One step for every start: moments by bin of distance, then of the nearest bins up to ``coverage``."""
    known = state.select("k", "start", "total", "mean", "cov", "inv", "n", F.col("logdet").alias("before")).withColumnRenamed("n", "size")
    near = rows.join(_per_group(known, 3 * groups), "k").withColumn("bin", F.floor(F.log2(_distance() + 1e-6) * BINS).cast("int"))
    bins = near.groupBy("lang", "k", "start", "total", "before", "bin").agg(
        F.count("*").alias("n"), *_moments(), *[F.first(c).alias("old_" + c) for c in ("mean", "cov", "size")]
    )

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("bin")
        n = np.cumsum(table.column("n").to_numpy())
        total = int(n[-1])
        k = int(np.searchsorted(n, coverage * total)) + 1
        size = int(n[k - 1])
        s = table.column("s").combine_chunks().flatten().to_numpy().reshape(-1, D)[:k].sum(axis=0)
        c = _square(table.column("c").combine_chunks().flatten().to_numpy().reshape(-1, len(HALF))[:k].sum(axis=0))
        mean = s / size
        cov = (c / size - np.outer(mean, mean)) * consistency(size / total)
        first = lambda x: table.column(x)[0].as_py()
        if np.linalg.slogdet((cov + cov.T) / 2 + NOISE)[1] > first("before"):  # the share is cut at a bin: a step may overshoot
            mean, cov, size = np.array(first("old_mean")), np.array(first("old_cov")).reshape(D, D), first("old_size")
        return pa.Table.from_batches([_state_batch([_state_row(first("lang"), first("k"), first("start"), total, size, mean, (cov + cov.T) / 2, first("before"))])])

    return bins.groupBy("k", "start").applyInArrow(run, STATE)


def mcd(rows: DataFrame, coverage: float = 0.75, steps: int = 60, prior: int = 5) -> tuple[DataFrame, int]:
    """k, mean, inv per group key of ``rows`` (lang, k, x0, x1, ..), and the number of groups.

    Steps go on while any start of any group still moves, ``steps`` at most (a dozen is usual); groups at rest are not read again.
    """
    state, groups = starts(rows)
    # The starts are not estimates of a nearest share yet: their determinants do not compare.
    state, done = scratch(concentrate(rows, state.withColumn("logdet", F.lit(float("inf"))), groups, coverage), "mcd"), []
    for _ in range(steps):
        moving = state.where("moved")
        if moving.isEmpty():
            break
        done.append(state.where("not moved"))
        state = scratch(concentrate(rows, moving, groups, coverage), "mcd")
    for d in done:
        state = state.unionByName(d)
    best = state.groupBy("lang", "k").agg(F.min_by(F.struct("n", "mean", "cov"), F.struct("logdet", "start")).alias("e")).select("lang", "k", "e.*")
    best = scratch(best, "mcd")
    every = best.groupBy("lang").agg(
        F.sum("n").alias("all"),
        F.expr("array(" + ", ".join(f"sum(n * mean[{i}])" for i in range(D)) + ")").alias("ms"),
        F.expr("array(" + ", ".join(f"sum(n * cov[{i}])" for i in range(D * D)) + ")").alias("cs"),
    )

    def run(batches):
        for b in batches:
            mean, inv = [], []
            for r in b.to_pylist():
                w = prior / (r["n"] + prior)
                mean.append(((1 - w) * np.array(r["mean"]) + w * np.array(r["ms"]) / r["all"]).tolist())
                cov = (1 - w) * np.array(r["cov"]) + w * np.array(r["cs"]) / r["all"]
                inv.append(np.linalg.inv(cov.reshape(D, D) + NOISE).ravel().tolist())
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(mean, pa.list_(pa.float64())), pa.array(inv, pa.list_(pa.float64()))], names=["k", "mean", "inv"])

    joined = best.join(_per_group(every, groups), best["lang"].eqNullSafe(every["lang"])).select("k", "n", "mean", "cov", "all", "ms", "cs")
    return scratch(joined.mapInArrow(run, "k string, mean array<double>, inv array<double>"), "mcd"), groups


def measured(stats: DataFrame) -> DataFrame:
    """``stats`` with the measures as columns x0, x1, .. and the group's key ``k``."""
    for i, e in enumerate(MEASURES):
        stats = stats.withColumn(f"x{i}", F.expr(e.replace("n_words", "greatest(n_words, 1)")))
    named = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    return stats.withColumn("k", F.to_json(F.array(named("lang"), named("source"))))


def judge(docs: DataFrame, tail: float = 1 - 1e-5, coverage: float = 0.75, steps: int = 60, prior: int = 5, whole: bool = False) -> DataFrame:
    """doc_id, the counts, base_failed, kept and distance2, one row per row of ``docs``; with ``whole`` also ``rest``, the row."""
    stats = scratch(measured(statistics(docs, whole).withColumn("base_failed", base_failed())), "stats")
    fit = stats.where(~F.col("base_failed")).select("lang", "k", *XS)
    state, groups = mcd(fit, coverage, steps, prior)
    limit = chi2_quantile(tail, D)
    seen = fit.join(_per_group(state, groups), "k").groupBy("k").agg(F.percentile_approx(_distance(), TRUSTED, 1000).alias("q"))
    wider = F.greatest(F.lit(1.0), F.col("q") / F.lit(chi2_quantile(TRUSTED, D)))
    limits = scratch(state.join(_per_group(seen, groups), "k").select("k", "mean", "inv", (wider * limit).alias("limit")), "mcd")
    out = stats.join(_per_group(limits, groups), "k", "left").withColumn("distance2", _distance())
    kept = ~F.col("base_failed") & (F.coalesce(F.col("distance2"), F.lit(0.0)) <= F.coalesce(F.col("limit"), F.lit(0.0)))
    names = [x.split()[0] for x in STATS.split(", ")]
    return out.select("doc_id", *names, "base_failed", kept.alias("kept"), "distance2", *(["rest"] if whole else []))


def keep(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are kept, each by its own text, with all their columns."""
    return judge(docs, whole=True, **options).where("kept").select(*[F.col("rest")[c].alias(c) for c in docs.columns])
