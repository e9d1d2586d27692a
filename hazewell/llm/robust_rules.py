"""Quality rules by robust multivariate outliers, in DataFrame functions only.

Each text gives counts, the counts give a vector of transformed statistics, and every (language, source) group gets a
minimum-covariance-determinant estimate of their centre and scatter: from two robust starts, concentration steps keep the
half of the group that lies nearest to the last estimate; the start that ends with the smaller determinant wins. Rows
beyond a cut-off on the robust Mahalanobis distance are rejected.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazewell.llm.common import WHITE, WHITE_RUN, small, trimmed
from hazewell.session import stored

WINDOW = 8
MIN_WORDS = 20
MOST_REPEATED = 30
SYMBOLS = "#*$%&|<>"
#: Groups of fewer rows share the estimate of their language's small groups, or that of all small ones.
MIN_GROUP = 100
STEPS = 3
#: Rows farther than this many robust units from the centre are rejected: the root of the 0.999 quantile of chi-squared
#: with five degrees of freedom.
CUTOFF = 4.53
#: Standard deviations below which a statistic's spread is not believed (where over half of a group is equal, the
#: estimate would otherwise have no determinant): for each statistic in the order of ``VECTOR``. A floor times the cut-off
#: lies inside the statistic's range, so that each one alone can reject: about half of the lines being duplicates, or 23 %
#: of the words repeated (more than 30 % fail the base rules).
FLOORS = (0.08, 0.25, 0.17, 0.11, 1.0)
VECTOR = ("v0", "v1", "v2", "v3", "v4")
BINS_PER_UNIT = 16
P = len(VECTOR)
LOWER = [(i, j) for i in range(P) for j in range(i + 1)]


def text_counts(text: Column) -> dict[str, Column]:
    """Columns to add one after the other: words (an array), then counts; null text has none."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n", -1), lambda line: F.btrim(line, F.lit(WHITE)) != "")
    at = F.sequence(F.lit(1), F.size("_words") - (WINDOW - 1))
    windows = F.when(F.size("_words") >= WINDOW, F.transform(at, lambda i: F.xxhash64(F.slice("_words", i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    # windows in order of number, then place: equal ones are neighbours
    order = F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twice = F.filter("_order", lambda x, k: F.coalesce(F.get("_order", k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("_order", k + 1)["h"] == x["h"], F.lit(False)))
    covered = F.aggregate("_places", F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")), lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n")), lambda acc: acc["n"])
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    return {
        "_words": F.when(trimmed(text) == "", F.array().cast("array<string>")).otherwise(F.split(trimmed(text), WHITE_RUN)),
        "_lines": lines,
        "_windows": windows,
        "_order": F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), order).otherwise(none),
        "_places": F.array_sort(F.transform(twice, lambda x: x["i"])),
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.translate(whole, WHITE, "")).cast("long"),
        "n_symbols": (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": covered.cast("long"),
    }


def with_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words to each row."""
    counts = text_counts(F.col(text))
    rows = df.select(*[c for c in df.columns if c.lower() not in counts])
    for name, value in counts.items():
        rows = rows.withColumn(name, value)
    return rows.drop("_words", "_lines", "_windows", "_order", "_places")


def vector() -> dict[str, Column]:
    """Variance-steadying transforms of the counts; none depends on the text's length but the last, which is weak."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "v0": F.log((F.col("word_chars") + 1) / n),
        "v1": F.asinh(F.lit(10.0) * F.col("n_symbols") / n),
        "v2": F.asin(F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)))),
        "v3": F.asin(F.sqrt(F.col("n_repeat_words") / n)),
        "v4": F.log1p(F.col("n_words")),
    }


def _cholesky(df: DataFrame, cov: str, out: str) -> DataFrame:
    """Columns ``{out}{i}{j}``, the lower factor of the scatter in ``{cov}{i}{j}``, and ``{out}det``, log of its determinant."""
    for i, j in LOWER:
        rest = F.col(f"{cov}{i}{j}")
        for k in range(j):
            rest = rest - F.col(f"{out}{i}{k}") * F.col(f"{out}{j}{k}")
        df = df.withColumn(f"{out}{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"{out}{j}{j}"))
    return df.withColumn(f"{out}det", sum((F.log(F.col(f"{out}{i}{i}")) * 2 for i in range(P)), F.lit(0.0)))


def _distance(df: DataFrame, start: str, out: str) -> DataFrame:
    """Mahalanobis distance of the row's vector from centre ``{start}m{i}`` under factor ``{start}l{i}{j}``."""
    y = []
    for i in range(P):
        rest = F.col(VECTOR[i]) - F.col(f"{start}m{i}")
        for k in range(i):
            rest = rest - y[k] * F.col(f"{start}l{i}{k}")
        df = df.withColumn(f"_y{i}", rest / F.col(f"{start}l{i}{i}"))
        y.append(F.col(f"_y{i}"))
    return df.withColumn(out, F.sqrt(sum((c * c for c in y), F.lit(0.0)))).drop(*[f"_y{i}" for i in range(P)])


def _bin(distance) -> Column:
    """A distance's place on a logarithmic scale: 1/16 of an octave wide, bounded at both ends."""
    return F.greatest(F.lit(-320), F.least(F.lit(640), F.floor(F.log2(F.greatest(distance, F.lit(1e-9))) * BINS_PER_UNIT))).cast("int")


def _half(rows: DataFrame, bins: list[str]) -> DataFrame:
    """For each group and each binned distance the bin that holds the nearer half: (n + P + 1) / 2 rows or a few more."""
    long = rows.select("g", F.explode(F.array(*[F.struct(F.lit(i).alias("s"), F.col(b).alias("b")) for i, b in enumerate(bins)])).alias("x")).select("g", "x.*")
    counts = long.groupBy("g", "s", "b").agg(F.count("*").alias("n"))
    up = Window.partitionBy("g", "s").orderBy("b")
    counts = counts.withColumn("upto", F.sum("n").over(up)).withColumn("all", F.sum("n").over(Window.partitionBy("g", "s")))
    reach = counts.filter(F.col("upto") * 2 >= F.col("all") + P + 1).groupBy("g", "s").agg(F.min("b").alias("b"))
    return reach.groupBy("g").agg(*[F.min(F.when(F.col("s") == i, F.col("b"))).alias(f"half{i}") for i in range(len(bins))])


def _moments(rows: DataFrame, kept: dict[str, Column], factor: float) -> DataFrame:
    """Centre and factored scatter of the kept rows for each start, one aggregate. Sums are taken about a fixed point near
    the data, in decimals of fixed scale: their order doesn't change them, so reruns agree."""
    sums = []
    x = [F.col(v) for v in VECTOR]
    exact = lambda c: F.sum(c.cast("decimal(24,12)")).cast("double")
    for s, keep in kept.items():
        sums.append(F.sum(F.when(keep, 1).otherwise(0)).alias(f"{s}n"))
        sums += [exact(F.when(keep, x[i])).alias(f"{s}s{i}") for i in range(P)]
        sums += [exact(F.when(keep, x[i] * x[j])).alias(f"{s}q{i}{j}") for i, j in LOWER]
    est = rows.groupBy("g").agg(*sums)
    for s in kept:
        n = F.greatest(F.col(f"{s}n"), F.lit(1))
        est = est.withColumns({f"{s}m{i}": F.coalesce(F.col(f"{s}s{i}"), F.lit(0.0)) / n for i in range(P)})
        cov = {}
        for i, j in LOWER:
            c = (F.coalesce(F.col(f"{s}q{i}{j}"), F.lit(0.0)) / n - F.col(f"{s}m{i}") * F.col(f"{s}m{j}")) * F.lit(factor)
            cov[f"{s}c{i}{j}"] = c + F.lit(FLOORS[i] ** 2) if i == j else c
        est = _cholesky(est.withColumns(cov), f"{s}c", f"{s}l")
    return est.select("g", *[c for s in kept for c in [f"{s}n", *[f"{s}m{i}" for i in range(P)], *[f"{s}l{i}{j}" for i, j in LOWER], f"{s}ldet"]])


def _starts(rows: DataFrame) -> DataFrame:
    """Two robust starts for each group: the median vector with scaled median deviations, and the median with the scatter floors."""
    long = rows.select("g", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.round(F.col(v) * 200).cast("int").alias("b")) for i, v in enumerate(VECTOR)])).alias("x")).select("g", "x.*")
    counts = long.groupBy("g", "i", "b").agg(F.count("*").alias("n"))
    ends = Window.partitionBy("g", "i")
    up = counts.withColumn("upto", F.sum("n").over(ends.orderBy("b"))).withColumn("all", F.sum("n").over(ends))
    quarter = lambda q: F.min(F.when(F.col("upto") >= F.col("all") * q, F.col("b"))) / 200.0
    each = up.groupBy("g", "i").agg(quarter(0.5).alias("m"), (quarter(0.75) - quarter(0.25)).alias("iqr"))
    wide = each.groupBy("g").agg(*[F.min(F.when(F.col("i") == i, F.col(c))).alias(f"{c}{i}") for i in range(P) for c in ("m", "iqr")])
    cols: dict[str, Column] = {}
    for i in range(P):
        spread = F.sqrt(F.pow(F.col(f"iqr{i}") / 1.349, F.lit(2.0)) + FLOORS[i] ** 2)
        cols |= {f"am{i}": F.col(f"m{i}"), f"bm{i}": F.col(f"m{i}")}
        cols |= {f"{s}l{i}{j}": (spread if s == "a" else F.lit(FLOORS[i])) if i == j else F.lit(0.0) for s in "ab" for j in range(i + 1)}
    return wide.select("g", *[c.alias(n) for n, c in cols.items()])


def estimates(rows: DataFrame, steps: int = STEPS) -> DataFrame:
    """The minimum-covariance-determinant estimate of each group ``g`` of a stored frame of vectors: m0.., l00.., n.

    Scatter is that of the nearer half, widened to be right for normal data, plus the squared floors on its diagonal.
    """
    # variance of the half of a normal vector nearest to its centre, against the whole: 1 / 0.5 * P(chi2(P+2) <= median of chi2(P))
    q = 4.3515
    chi7 = math.erf(math.sqrt(q / 2)) - math.sqrt(2 * q / math.pi) * math.exp(-q / 2) * (1 + q / 3 + q * q / 15)
    factor = 0.5 / chi7
    est = stored(_starts(rows), "mcd-start")
    for _ in range(steps):
        near = _distance(_distance(rows.join(small(est), "g"), "a", "da"), "b", "db").withColumns({"ba": _bin("da"), "bb": _bin("db")}).select("g", *VECTOR, "ba", "bb")
        half = stored(_half(near, ["ba", "bb"]), "mcd-half")
        kept = near.join(small(half), "g")
        est = stored(_moments(kept, {"a": F.col("ba") <= F.col("half0"), "b": F.col("bb") <= F.col("half1")}, factor), "mcd-step")
    better = F.col("aldet") <= F.col("bldet")
    names = [*[f"m{i}" for i in range(P)], *[f"l{i}{j}" for i, j in LOWER]]
    return est.select("g", *[F.when(better, F.col(f"a{n}")).otherwise(F.col(f"b{n}")).alias(n) for n in names])


def fit(counts: DataFrame, min_group: int = MIN_GROUP, steps: int = STEPS) -> tuple[DataFrame, DataFrame]:
    """The group of each (language, source), and each group's estimate, from a stored frame of ``_with_vector``: two small stored tables."""
    used = counts.filter(~F.col("base_failed"))
    sizes = used.groupBy("_l", "_s").agg(F.count("*").alias("n"))
    per_lang = sizes.filter(F.col("n") < min_group).groupBy("_l").agg(F.sum("n").alias("n_lang"))
    key = F.when(F.col("n") >= min_group, F.concat_ws("|", F.lit("s"), "_l", "_s")).when(F.col("n_lang") >= min_group, F.concat_ws("|", F.lit("l"), "_l")).otherwise(F.lit("a"))
    groups = stored(sizes.join(per_lang, "_l", "left").select("_l", "_s", key.alias("g")), "quality-groups")
    fitted = used.join(small(groups), ["_l", "_s"], "left").select("g", *VECTOR)
    enough = fitted.groupBy("g").agg(F.count("*").alias("n")).filter(F.col("n") >= min_group).select("g")
    return groups, stored(estimates(stored(fitted.join(small(stored(enough, "quality-enough")), "g"), "quality-vectors"), steps), "mcd")


def apply(counts: DataFrame, groups: DataFrame, est: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """Add distance and kept to the rows of ``_with_vector``; the helping columns go."""
    keyed = counts.join(small(groups), ["_l", "_s"], "left")
    found = _distance(keyed.join(small(est), "g", "left").withColumnsRenamed({n: f"_e{n}" for n in est.columns if n != "g"}), "_e", "distance")
    found = found.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(F.col("distance") > cutoff, F.lit(False)))
    return found.drop("g", "_l", "_s", *VECTOR, *[f"_e{n}" for n in est.columns])


def judge(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", cutoff: float = CUTOFF, min_group: int = MIN_GROUP, steps: int = STEPS) -> DataFrame:
    """Every row with its counts, base_failed, distance and kept (columns of those names give way to them).

    base_failed: fewer than 20 words, or over 30 % of the words in repeated windows. kept is false if base_failed, else
    false if the distance exceeds ``cutoff``. Estimates rest on all rows that pass the base rules. A null or empty text
    has counts of 0 and fails. Null languages and sources form groups of their own. Groups of fewer than ``min_group``
    rows use one estimate of their language's small groups together, and if those are too few, one of all such; where
    even these are too few there is no distance (null) and the row is kept. Rows are neither dropped nor merged.
    The text itself is left out: what is kept of each row is written to the shared folder once.
    """
    counts = stored(_with_vector(df, text, lang, source).drop(text), "quality-counts")
    return apply(counts, *fit(counts, min_group, steps), cutoff)


def _with_vector(df: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    rows = with_counts(df.drop("base_failed", "kept", "distance"), text)
    value = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))
    failed = (F.col("n_words") < MIN_WORDS) | (F.lit(100) * F.col("n_repeat_words") > F.lit(MOST_REPEATED) * F.col("n_words"))
    return rows.withColumns(vector() | {"_l": value(lang), "_s": value(source), "base_failed": failed})


def reject(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", cutoff: float = CUTOFF, min_group: int = MIN_GROUP, steps: int = STEPS) -> DataFrame:
    """The rows that ``judge`` keeps, with all their own columns, whatever these are called.

    Texts are counted once for the estimates and once more for the verdicts: no text is written, and none is shuffled.
    The row number in the condition keeps the optimizer from moving it below the counts, where each lambda that reads the
    words would split the text anew for every element.
    """
    parts = [F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(source).alias("source")]
    counts = _with_vector(df.select(*parts), "text", "lang", "source").select("_l", "_s", "base_failed", *VECTOR)
    groups, est = fit(stored(counts, "quality-counts"), min_group, steps)
    whole = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("whole"), *parts)
    rows = _with_vector(whole, "text", "lang", "source").withColumn("_row", F.monotonically_increasing_id())
    return apply(rows, groups, est, cutoff).filter("kept AND _row >= 0").select("whole.*")
