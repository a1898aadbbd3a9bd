"""Quality rules: robust multivariate outliers by minimum-covariance-determinant estimates per language and source.

Only DataFrame functions run. Statistics of every document come from array functions on its words and lines. Within each
(language, source) the transformed statistics of the documents that pass the base rules get a location and a covariance
by concentration steps: distances to the current estimate, the half with the smallest distances, the moments of that half
(h = (n + p + 1) / 2 of n rows in p dimensions, so that nearly half of a group may be junk).
A step is one aggregation: moments are summed for each group and fine bin of the distance, a running count over the bins
finds those of the nearest share, and their sums give the next estimate. So nothing grows with a group but its count, and
a source that holds most rows is aggregated before any exchange. Two starts run side by side (all rows; coordinatewise
medians), each until nothing changes or STEPS are done; that of the smaller determinant stays. As usual it is then reweighted: the moments of the rows within the central
quantile of the chi-square distribution around it, which junk further away cannot enter however much there is, give the
final estimate. A document is rejected if its squared Mahalanobis distance is beyond a far quantile of that distribution.

Variances never fall below those of NOISE, since most clean documents have no symbols or repetitions at all. They are so
low that each statistic alone can reach the cut-off: in a group that has none, 6% symbols or 24% repeated lines or words.

Defined cases: null or empty text, or one without words: base_failed. Null languages or sources form groups of their own.
Groups of fewer than MIN_GROUP documents that pass the base rules take the estimate of all rows of their language; where
that has fewer too, of all rows; where those are fewer, the base rules decide alone. Repeated rows each get their row. Further columns are ignored by `quality` and kept by `kept`; clashing names do no harm.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import SPACE_CHARS, checkpoint, filter_pages, marked, words

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Least standard deviations of the transformed statistics: log word length; square roots of shares of symbols, repeated
#: lines, repeated words.
NOISE = (0.05, 0.05, 0.1, 0.1)
#: Steps at most, the central quantile of the reweighting, and the quantile beyond which a document is rejected.
STEPS, CENTRAL, QUANTILE = 8, 0.75, 0.9999
#: A step that changes no group's log-determinant by as much is the last one.
STABLE = 1e-3
#: Statistics are multiples of 1 / GRID: so the sums of up to three thousand million rows are exact, whatever their order, and
#: a median's counts of values are bounded.
GRID = 1024
MIN_GROUP = 8
#: The language or source of estimates that are pooled over all of them; no known one or null is written so.
ALL = "*"
#: Keys that a group is dealt over.
SALTS = 32
BINS = 32  # per doubling of the squared distance
P = len(NOISE)
X = [f"x{i}" for i in range(P)]
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]


def statistics(docs: DataFrame) -> DataFrame:
    """The base columns of every document, with language and source."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").alias("lang"), F.col("source").alias("source"), text.alias("text"))
    rows = rows.withColumns({
        "w": words(F.col("text")), "lines": F.filter(F.split("text", "\n"), lambda x: F.translate(x, SPACE_CHARS, "") != ""),
        "word_chars": F.length(F.translate("text", SPACE_CHARS, "")).cast("long"), "n_symbols": (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long"),
    })
    # hashes of the three-word windows, one for each word that has two after it
    rows = rows.select("doc_id", "lang", "source", "word_chars", "n_symbols", F.size("w").cast("long").alias("n_words"), F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
                       F.transform(F.slice("w", 1, F.greatest(F.size("w") - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2))).alias("windows"))
    twice = F.size(F.array_distinct("windows")) < F.size("windows")
    rows = rows.withColumn("sorted", F.when(twice, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    rows = rows.withColumn("again", F.filter("sorted", lambda x, k: (F.get("sorted", k + 1)["h"] == x["h"]) | F.when(k > 0, F.get("sorted", k - 1)["h"] == x["h"]).otherwise(False)))
    covered = F.size(F.array_distinct(F.flatten(F.transform("again", lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))
    rows = rows.withColumn("n_repeat_words", F.when(F.col("again").isNull(), 0).otherwise(covered).cast("long")).drop("windows", "sorted", "again")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def vectors(stats: DataFrame) -> DataFrame:
    share = lambda a, b: F.sqrt(F.col(a) / F.greatest(F.col(b), F.lit(1)))
    x = [F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1))), share("n_symbols", "word_chars"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words")]
    return stats.withColumns({k: F.round(v * GRID) / GRID for k, v in zip(X, x, strict=True)})


def _even_chi2(df: int, x: float) -> float:
    """The chi-square distribution function for an even number of degrees of freedom."""
    term = total = 1.0
    for k in range(1, df // 2):
        term *= x / 2 / k
        total += term
    return 1 - math.exp(-x / 2) * total


def _even_chi2_quantile(df: int, q: float) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _even_chi2(df, mid) < q else (lo, mid)
    return hi


def _consistent(share: float) -> float:
    """What makes the covariance of the nearest share consistent for normal data."""
    return share / _even_chi2(P + 2, _even_chi2_quantile(P, share))


HALF_CONSISTENT, CONSISTENT = _consistent(0.5), _consistent(CENTRAL)
NEAR = _even_chi2_quantile(P, CENTRAL)
CUTOFF = _even_chi2_quantile(P, QUANTILE)


SUMS = ["n", *[f"s_{x}" for x in X], *[f"s_{i}{j}" for i, j in PAIRS]]


def _moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    sums = [f"sum({x}) AS s_{x}" for x in X] + [f"sum({X[i]} * {X[j]}) AS s_{i}{j}" for i, j in PAIRS]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *map(F.expr, sums))


def _estimate(sums: DataFrame, keep: list[str], factor: float) -> DataFrame:
    """Location m*, inverse Cholesky factor k* and log-determinant from sums. A column of the factor is one projection, and
    so is a diagonal of its inverse: the driver analyses each of them at every step."""
    rows = sums.selectExpr(*keep, *[f"s_{x} / n AS m{i}" for i, x in enumerate(X)], *[f"s_{i}{j}" for i, j in PAIRS], "n")
    cov = lambda i, j: f"s_{i}{j} / n - m{i} * m{j}"
    rows = rows.selectExpr(*keep, *[f"m{i}" for i in range(P)], *[f"{factor!r}D * greatest({cov(i, j)}, 0D) + {NOISE[i] ** 2!r}D AS c{i}{j}" if i == j else f"{factor!r}D * ({cov(i, j)}) AS c{i}{j}" for i, j in PAIRS])
    for j in range(P):
        inner = {i: " - ".join([f"c{i}{j}", *[f"l{i}{k} * l{j}{k}" for k in range(j)]]) for i in range(j, P)}
        rows = rows.withColumn(f"l{j}{j}", F.expr(f"sqrt(greatest({inner[j]}, 1e-12D))"))
        rows = rows.withColumns({f"l{i}{j}": F.expr(f"({inner[i]}) / l{j}{j}") for i in range(j + 1, P)})
    rows = rows.withColumns({f"k{i}{i}": F.expr(f"1D / l{i}{i}") for i in range(P)})
    for d in range(1, P):
        below = {(i, i - d): " + ".join(f"l{i}{k} * k{k}{i - d}" for k in range(i - d, i)) for i in range(d, P)}
        rows = rows.withColumns({f"k{i}{j}": F.expr(f"-({x}) / l{i}{i}") for (i, j), x in below.items()})
    return rows.selectExpr(*keep, *[f"m{i}" for i in range(P)], *[f"k{i}{j}" for i, j in PAIRS], " + ".join(f"ln(l{i}{i})" for i in range(P)) + " AS logdet")


def _distance() -> Column:
    parts = [" + ".join(f"k{i}{j} * ({X[j]} - m{j})" for j in range(i + 1)) for i in range(P)]
    return F.expr(" + ".join(f"({y}) * ({y})" for y in parts))


def _with_estimates(rows: DataFrame, found: DataFrame, how: str = "inner", keys: tuple[str, ...] = ("g_lang", "g_source")) -> DataFrame:
    """Rows with their group's columns. A group's rows are dealt over SALTS keys, on each of which its columns stand once,
    so a source that holds a large part of all rows is many tasks' work."""
    salts = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", *X), F.lit(SALTS)).cast("int")).join(salts, [*keys, "salt"], how).drop("salt")


def estimates(rows: DataFrame) -> DataFrame:
    """For each group (g_lang, g_source) of `rows` with doc_id and x*, its estimate; groups below MIN_GROUP have none."""
    group = ["g_lang", "g_source"]
    plain = checkpoint(_moments(rows, group).where(F.col("n") >= MIN_GROUP))
    sizes = plain.select(*group, F.col("n").alias("size"))
    medians = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), *[F.percentile(x, 0.5).alias(f"s_{x}") for x in X]).where(F.col("n") >= MIN_GROUP)
    # a diagonal covariance of the least variances around the medians
    medians = medians.select(*group, *[(F.col(f"s_{x}") * F.col("n")).alias(f"s_{x}") for x in X], *[(F.col(f"s_{X[i]}") * F.col(f"s_{X[j]}") * F.col("n")).alias(f"s_{i}{j}") for i, j in PAIRS], "n")
    starts = plain.withColumn("start", F.lit(0)).unionByName(medians.withColumn("start", F.lit(1)))
    now = checkpoint(_estimate(starts, [*group, "start"], 1.0))
    keys = [*group, "start"]
    for _ in range(STEPS):
        bins = _with_estimates(rows.select("doc_id", *group, *X), now.withColumnRenamed("logdet", "was"))
        bins = _moments(bins.withColumn("bin", F.floor(BINS * F.log2(_distance() + 1e-9))), [*keys, "was", "bin"])
        upto = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        half = F.floor((F.col("size") + P + 1) / 2)
        nearest = bins.withColumn("below", F.coalesce(F.sum("n").over(upto), F.lit(0))).join(sizes, group).where(F.col("below") < half)
        sums = nearest.groupBy(*keys, "was").agg(*[F.expr(f"sum({c}) AS {c}") for c in SUMS])
        step = checkpoint(_estimate(sums, [*keys, "was"], HALF_CONSISTENT))
        now = step.drop("was")
        if (step.agg(F.expr("max(abs(logdet - was))")).first()[0] or 0.0) < STABLE:
            break
    best = Window.partitionBy(*group).orderBy("logdet", "start")
    now = checkpoint(now.withColumn("nth", F.row_number().over(best)).where("nth = 1").drop("nth", "start", "logdet"))
    near = _with_estimates(rows.select("doc_id", *group, *X), now).where(_distance() <= NEAR)
    return checkpoint(_estimate(_moments(near, group), group, CONSISTENT).drop("logdet"))


def pooled(rows: DataFrame) -> DataFrame:
    """`estimates`, and for each small group of `rows` that of its language or else of all rows, where they are enough."""
    group = ["g_lang", "g_source"]
    sizes = checkpoint(rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n")))
    langs = sizes.groupBy("g_lang").agg(F.sum("n").alias("n_lang"), F.sum(F.when(F.col("n") < MIN_GROUP, 1).otherwise(0)).alias("small")).where("small > 0")
    langs = checkpoint(langs.drop("small"))
    if langs.isEmpty():
        return estimates(rows)
    plain = rows.select("doc_id", *group, *X)
    wide = _with_estimates(plain, langs.where(F.col("n_lang") >= MIN_GROUP), keys=("g_lang",)).drop("n_lang").withColumn("g_source", F.lit(ALL))
    if not langs.where(F.col("n_lang") < MIN_GROUP).isEmpty():
        wide = wide.unionByName(plain.withColumns({"g_lang": F.lit(ALL), "g_source": F.lit(ALL)}))
    # groups and pools take their steps together
    found = estimates(checkpoint(plain.unionByName(wide)))
    of_pools = found.where(F.col("g_source") == ALL).withColumnsRenamed({"g_lang": "p_lang", "g_source": "p_source"})
    small = sizes.where(F.col("n") < MIN_GROUP).join(langs, "g_lang")
    small = small.select(*group, F.when(F.col("n_lang") >= MIN_GROUP, F.col("g_lang")).otherwise(ALL).alias("p_lang"), F.lit(ALL).alias("p_source"))
    own = found.where(F.col("g_source") != ALL)
    return checkpoint(own.unionByName(small.join(of_pools, ["p_lang", "p_source"]).drop("p_lang", "p_source")))


def _with_groups(docs: DataFrame) -> DataFrame:
    known = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null"))
    return vectors(statistics(docs)).withColumns({"g_lang": known("lang"), "g_source": known("source")}).drop("lang", "source")


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, the base columns, base_failed, kept, and the squared distance (null if the base rules decide alone)."""
    stats = checkpoint(_with_groups(docs))
    found = pooled(stats.where(~F.col("base_failed")))
    rows = _with_estimates(stats, found, "left").withColumn("distance", F.when(~F.col("base_failed"), _distance()))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= CUTOFF, F.lit(True))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), F.round("distance", 6).alias("distance"))


def kept(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with all their columns. Rows are matched to their verdict by a digest of what
    the verdict depends on, so repeated doc_ids or null ones do no harm: equal texts of one group have one verdict."""
    key = F.xxhash64(F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("null")), F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null")))
    known = docs.select(key.alias("doc_id"), "lang", "source", "text")
    bad = checkpoint(judged(known).where(~F.col("kept")).select(F.col("doc_id").alias("__plumbline_rejected")).distinct())
    spot = marked(docs, key, filter_pages(bad, F.col("__plumbline_rejected")), "__plumbline_near")
    # only texts that may be rejected are exchanged
    left = spot.where("not __plumbline_near")
    near = spot.where("__plumbline_near").join(bad, key == F.col("__plumbline_rejected"), "left_anti")
    return left.union(near).drop("__plumbline_near")
