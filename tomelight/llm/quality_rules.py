"""Quality rules: fixed base rules, and robust multivariate outliers per language and source.

Everything is DataFrame expressions.  A document's counts become five transformed statistics.  For
each group the minimum-covariance-determinant estimate comes from concentration steps: from each of
several starts (medians and median absolute deviations, moments of parts of the rows) take mean and
covariance of the ``CORE`` share of rows that lie closest, again and again until the determinant
falls no more, and keep the smallest.  A group's estimate is then drawn towards its language's, the more so
the fewer rows it has.  A document is an outlier beyond ``CUTOFF`` in squared Mahalanobis distance.
Covariances are inverted by a Cholesky factor written out in columns.  Order statistics are those of
values on a fixed grid, counted, so they don't depend on how rows are partitioned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import fill_cores
from .common import SPACE_CLASS, discard, store

#: Share of a group's rows that each concentration step keeps.
CORE = 0.75
#: A start's steps end once its determinant's logarithm falls by no more than this.  As variances have a
#: least value, determinants cannot fall for ever.
SETTLED = 1e-3
#: Starts from moments of one part in ``START_PARTS`` of a group's rows, besides the one from medians.
PART_STARTS, START_PARTS = 3, 8
#: Parts into which a group's rows are dealt when its estimates are joined to them.
SALTS = 32
#: Rows that a group's language counts for when the group's estimate is drawn towards the language's.
PRIOR_ROWS = 50
#: Steps of the grid in a unit of a statistic, or of the logarithm of a squared distance.
GRID = 4096
FEATURES = ("f_words", "f_length", "f_symbols", "f_lines", "f_repeats")
#: Standard deviation that each statistic has at least: differences below it say nothing of quality.
#: Lines (at most 1) and repeats (at most 0.71) reach the cutoff alone.
LEAST_SPREAD = (0.8, 0.12, 0.05, 0.1, 0.1)
#: Their quarter, squared, is added to each variance so that no covariance is singular.
FLOORS = (0.2, 0.03, 0.0125, 0.025, 0.025)
#: Median of a chi-squared variable of five degrees, to which distances are scaled down.
CHI2_MEDIAN = 4.351
#: Its quantile at one in ten thousand.
CUTOFF = 25.74


def counted(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang, source and the base counts of each row; a null text has none of anything."""
    group = [F.coalesce(df[c].cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in ("lang", "source")]
    base = fill_cores(df.select(df[id_col].cast("long").alias("doc_id"), *group, F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text")))
    words = base.select(
        "doc_id",
        "lang",
        "source",
        F.array_remove(F.split("text", SPACE_CLASS + "+"), "").alias("w"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
    )
    n = F.size("w")
    # The word array is named more than once in the lambda, so the optimiser leaves it in its own projection.
    triples = words.select(
        "doc_id",
        "lang",
        "source",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))).alias("t"),
    )
    # Only texts with an equal pair of triples pay for the sort.
    repeats = triples.withColumn(
        "s", F.when(F.size("t") > F.size(F.array_distinct("t")), F.sort_array(F.transform("t", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    ).drop("t")
    again = F.filter("s", lambda x, k: (F.get("s", k - 1)["h"] == x["h"]) | (F.get("s", k + 1)["h"] == x["h"]))
    places = repeats.withColumn("p", F.sort_array(F.transform(again, lambda x: x["i"]))).drop("s")
    covered = F.aggregate(
        "p",
        F.struct(F.lit(0).cast("long").alias("c"), F.lit(-3).alias("l")),
        lambda acc, i: F.struct((acc["c"] + F.least(F.lit(3), i - acc["l"])).alias("c"), i.alias("l")),
        lambda acc: acc["c"],
    )
    return places.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines",
        F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"),
    )


def _features() -> list[Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return [
        F.log1p("n_words").alias(FEATURES[0]),
        F.log((F.col("word_chars") + 1) / words).alias(FEATURES[1]),
        F.sqrt(F.col("n_symbols") / (F.col("word_chars") + 1)).alias(FEATURES[2]),
        F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))).alias(FEATURES[3]),
        F.sqrt(F.col("n_repeat_words") / words).alias(FEATURES[4]),
    ]


def _keys(df: DataFrame) -> list[str]:
    """The group and, while there are several, the start."""
    return [c for c in ("g", "start") if c in df.columns]


def _raised(moments: DataFrame) -> DataFrame:
    """``moments`` with no variance below that of ``LEAST_SPREAD``."""
    return moments.withColumns({f"c_{i}_{i}": F.greatest(F.col(f"c_{i}_{i}"), F.lit(x**2)) for i, x in enumerate(LEAST_SPREAD)})


def _factored(moments: DataFrame, floors: tuple[float, ...] = FLOORS) -> DataFrame:
    """Means and factor; each entry is named once and used by name, so no expression is repeated."""
    n = len(FEATURES)
    steps: list[Column] = []
    for j in range(n):
        square = F.col(f"c_{j}_{j}") + F.lit(floors[j] ** 2)
        for k in range(j):
            square = square - F.col(f"l_{j}_{k}") * F.col(f"l_{j}_{k}")
        steps.append(F.sqrt(square).alias(f"l_{j}_{j}"))
        for i in range(j + 1, n):
            rest = F.col(f"c_{i}_{j}")
            for k in range(j):
                rest = rest - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            steps.append((rest / F.col(f"l_{j}_{j}")).alias(f"l_{i}_{j}"))
    size = sum(2 * F.log(F.col(f"l_{i}_{i}")) for i in range(n)).alias("log_det")
    was = ["was"] if "was" in moments.columns else []
    return moments.select("*", *steps, size).select(*_keys(moments), *was, *(f"m_{i}" for i in range(n)), *(f"l_{i}_{j}" for i in range(n) for j in range(i + 1)), "log_det")


def _with_estimates(rows: DataFrame, params: DataFrame) -> DataFrame:
    """``rows`` (with a salt) beside their group's row of ``params``; a group with most rows meets them in ``SALTS`` parts."""
    return rows.join(params.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["g", "salt"])


def _with_distance(rows: DataFrame, params: DataFrame) -> DataFrame:
    """``rows`` with d2, the squared distance under their group's ``params``."""
    n = len(FEATURES)
    steps: list[Column] = []
    for i in range(n):
        z = F.col(FEATURES[i]) - F.col(f"m_{i}")
        for k in range(i):
            z = z - F.col(f"l_{i}_{k}") * F.col(f"z_{k}")
        steps.append((z / F.col(f"l_{i}_{i}")).alias(f"z_{i}"))
    return _with_estimates(rows, params).select("*", *steps, sum(F.col(f"z_{i}") * F.col(f"z_{i}") for i in range(n)).alias("d2"))


def _moments(rows: DataFrame) -> DataFrame:
    """Means and covariances per group and start; ``was`` is the determinant that chose the rows, if there was one."""
    n = len(FEATURES)
    return rows.groupBy(*_keys(rows)).agg(
        *([F.first("log_det").alias("was")] if "log_det" in rows.columns else []),
        *(F.avg(FEATURES[i]).alias(f"m_{i}") for i in range(n)),
        *(F.covar_pop(FEATURES[i], FEATURES[j]).alias(f"c_{i}_{j}") for i in range(n) for j in range(i + 1)),
    )


def order_statistics(rows: DataFrame, keys: list[str], bins: list[str], share: float) -> DataFrame:
    """Per ``keys``, for each column of ``bins`` (whole numbers) the least value that ``share`` of the rows don't exceed.

    Rows are counted by value first, so a group of any size leaves one row a value.
    """
    each = rows.select(*keys, F.explode(F.array(*(F.struct(F.lit(b).alias("what"), F.col(b).alias("bin")) for b in bins))).alias("x")).select(*keys, "x.what", "x.bin")
    counts = each.groupBy(*keys, "what", "bin").agg(F.count(F.lit(1)).alias("n"))
    own = W.partitionBy(*keys, "what")
    reached = counts.select(*keys, "what", "bin", (F.sum("n").over(own.orderBy("bin")) >= F.sum("n").over(own) * share).alias("reached")).filter("reached")
    return reached.groupBy(*keys).agg(*(F.min(F.when(F.col("what") == b, F.col("bin"))).alias(b) for b in bins))


def _on_grid(value: Column) -> Column:
    return F.floor(value * GRID).cast("long")


def _step(rows: DataFrame, params: DataFrame) -> DataFrame:
    """The estimates of the ``CORE`` share of rows closest to each of ``params``; ``was`` is the determinant before.

    Distances are reckoned twice, once to be counted and once to be filtered: keeping them, or summing
    the rows by distance, would move far more than the counts do.
    """
    near = _with_distance(rows, params).withColumn("far", _on_grid(F.log1p("d2")))
    bound = order_statistics(near, ["g", "start"], ["far"], CORE).withColumnRenamed("far", "most")
    core = _with_distance(rows, params.join(bound, ["g", "start"])).filter(_on_grid(F.log1p("d2")) <= F.col("most"))
    return _factored(_raised(_moments(core)))


def _settled(rows: DataFrame) -> DataFrame:
    """Per group g of ``rows``: centre and Cholesky factor of the start whose core has the least determinant, and n rows."""
    n = len(FEATURES)
    at = [f"b_{i}" for i in range(n)]
    middle = order_statistics(rows.select("g", *(_on_grid(F.col(FEATURES[i])).alias(at[i]) for i in range(n))), ["g"], at, 0.5)
    middle = middle.select("g", *((F.col(at[i]) / GRID).alias(f"m_{i}") for i in range(n)))
    apart = _with_estimates(rows, middle).select("g", *(_on_grid(F.abs(F.col(FEATURES[i]) - F.col(f"m_{i}"))).alias(at[i]) for i in range(n)))
    spread = order_statistics(apart, ["g"], at, 0.5).join(middle, "g")
    first = spread.select(
        "g",
        F.lit(0).alias("start"),
        *(f"m_{i}" for i in range(n)),
        *(((1.4826 * F.col(at[i]) / GRID) ** 2 if i == j else F.lit(0.0)).alias(f"c_{i}_{j}") for i in range(n) for j in range(i + 1)),
    )
    parts = _moments(rows.withColumn("start", F.col("salt") % START_PARTS + 1).filter(F.col("start") <= PART_STARTS))
    moving = store(_factored(_raised(first.unionByName(parts))), "centres")
    params, first_step = None, True
    while not moving.isEmpty():
        after = store(_step(rows, moving), "centres")
        discard(moving)
        # What a start begins with is no estimate of a core, so its first step does not count.
        falls = F.lit(True) if first_step else F.col("log_det") < F.col("was") - SETTLED
        ended, moving = after.filter(~falls).drop("was"), after.filter(falls).drop("was")
        moving._stored_at = after._stored_at  # type: ignore[attr-defined]
        if not first_step:
            before, params = params, store(ended if params is None else params.unionByName(ended), "settled")
            if before is not None:
                discard(before)
        first_step = False
    if params is None:
        params = moving
    else:
        discard(moving)
    least = params.groupBy("g").agg(F.min(F.struct("log_det", "start")).alias("least")).select("g", F.col("least.start").alias("start"))
    sizes = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    best = store(params.join(least, ["g", "start"]).join(sizes, "g"), "least")
    discard(params)
    return best


def blended(best: DataFrame) -> DataFrame:
    """Centre and factor of each group (g, n rows, centre, factor), drawn towards those of its language.

    The language's are the moments of its groups' cores together.  A group of n rows weighs n
    against ``PRIOR_ROWS`` for the language, in the mixture of the two.
    """
    n = len(FEATURES)
    pairs = [(i, j) for i in range(n) for j in range(i + 1)]
    own = best.select(
        "g",
        F.get_json_object("g", "$.lang").alias("lang"),
        "n",
        *(f"m_{i}" for i in range(n)),
        *(sum(F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}") for k in range(j + 1)).alias(f"c_{i}_{j}") for i, j in pairs),
    )
    total = F.sum("n")
    whole = own.groupBy("lang").agg(
        *((F.sum(F.col("n") * F.col(f"m_{i}")) / total).alias(f"a_{i}") for i in range(n)),
        *((F.sum(F.col("n") * (F.col(f"c_{i}_{j}") + F.col(f"m_{i}") * F.col(f"m_{j}"))) / total).alias(f"s_{i}_{j}") for i, j in pairs),
    )
    w = F.col("n") / (F.col("n") + PRIOR_ROWS)
    both = own.join(whole, "lang").withColumn("w", w)
    gap = lambda i: F.col(f"m_{i}") - F.col(f"a_{i}")
    mixed = both.select(
        "g",
        *((F.col("w") * F.col(f"m_{i}") + (1 - F.col("w")) * F.col(f"a_{i}")).alias(f"m_{i}") for i in range(n)),
        *(
            (F.col("w") * F.col(f"c_{i}_{j}") + (1 - F.col("w")) * (F.col(f"s_{i}_{j}") - F.col(f"a_{i}") * F.col(f"a_{j}")) + F.col("w") * (1 - F.col("w")) * gap(i) * gap(j)).alias(f"c_{i}_{j}")
            for i, j in pairs
        ),
    )
    return _factored(mixed, (0.0,) * n)


def robust_estimates(rows: DataFrame) -> DataFrame:
    """Per group g of ``rows``: centre, Cholesky factor and the scale of distances under them."""
    best = _settled(rows)
    mixed = store(blended(best), "mixed")
    far = order_statistics(_with_distance(rows, mixed).withColumn("far", _on_grid(F.log1p("d2"))), ["g"], ["far"], 0.5)
    own = F.least(F.lit(1.0), F.lit(CHI2_MEDIAN) / F.expm1((F.col("far") + 1) / GRID))
    scaled = best.select("g", "n", F.get_json_object("g", "$.lang").alias("lang")).join(far.select("g", own.alias("own")), "g")
    whole = scaled.groupBy("lang").agg((F.sum(F.col("n") * F.col("own")) / F.sum("n")).alias("all"))
    scale = scaled.join(whole, "lang").select("g", ((F.col("n") * F.col("own") + PRIOR_ROWS * F.col("all")) / (F.col("n") + PRIOR_ROWS)).alias("scale"))
    return store(mixed.join(scale, "g"), "estimates")


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: the base counts, base_failed, d2 and kept.

    A null text counts as empty: all counts are 0 and the base rule fails it.  A null language or
    source counts as an empty name; where the columns are missing, all rows are one group.  A group
    of few rows is judged mostly by its language's estimate.  Repeated rows each give a row and count
    in the estimates.  An empty input gives no rows.  Rows that fail the base rule take no part in
    the estimates.  Columns of ``df`` other than identifier, text, lang and source play no part,
    whatever their names.
    """
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    group = F.to_json(F.struct("lang", "source")).alias("g")
    counts = counted(df, id_col, text_col).withColumn("salt", salt).withColumn("base_failed", failed)
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    featured = store(counts.select(*base, group, "salt", *_features()), "featured")
    estimates = robust_estimates(featured.filter("not base_failed").select("g", "salt", *FEATURES))
    measured = _with_distance(featured.filter("not base_failed"), estimates)
    passed = measured.select(*base, F.coalesce(F.col("d2") * F.col("scale") <= CUTOFF, F.lit(True)).alias("kept"), (F.col("d2") * F.col("scale")).alias("d2"))
    return passed.unionByName(featured.filter("base_failed").select(*base, F.lit(False).alias("kept"), F.lit(None).cast("double").alias("d2")))
