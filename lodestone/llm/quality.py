"""Quality rules: text statistics, base limits, and robust multivariate outliers per language and source.

All of it is DataFrame functions. The statistics of a text are computed inside
its row. Each (language, source) group then gets a minimum-covariance-
determinant estimate. Three deterministic starts (the scales alone, the
correlations of hyperbolic tangents, and spatial signs) take concentration
steps that re-estimate centre and covariance from the half of the group with
the least Mahalanobis distances; after START_STEPS the start of least
determinant goes on, in each group until its determinant no longer falls; a
group that has come to rest takes no part in further steps. The half's border comes
from a histogram of distances (integer counts, so no group is gathered or
sorted), and the rows of the border bin share what is left of the half as a
weight, so ties never make it larger. A group's estimate is drawn towards its
language's, and that towards all rows', by their numbers of rows: the parent
counts as PRIOR rows. Rows are rejected by their distance.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm import common

_WS = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Words in a window, for n_repeat_words.
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

#: Share of a group that the estimate is made of: floor((n + p + 1) / 2) of n rows, which withstands the most outliers.
HALF = 0.5
#: Concentration steps of every start; and the fall of a determinant's logarithm that is a rounding error, so that a group is at rest.
START_STEPS, SETTLED = 2, 1e-9
#: Bins of the histogram of distances in each factor e.
BINS = 64
#: Rows that the estimate of the language (or of all rows) counts in that of a group (or of a language).
PRIOR = 50
#: Halves of n normal rows in five dimensions lack SMALL / n of the covariance's size, so that CUTOFF stays about their 0.9999 quantile (simulated, 50 to 1000 rows).
SMALL = 95.0
#: Levels of an estimate.
GROUP, LANGUAGE, WHOLE = 0, 1, 2
#: Least standard deviation of each transformed statistic, so that a statistic that hardly varies in a group can't reject small changes.
FLOORS = {"log_words": 0.5, "word_length": 0.4, "symbols": 0.2, "dup_lines": 0.35, "repeats": 0.3}
#: Squared distance beyond which a row is rejected: the 0.9999 quantile of chi-squared with five degrees.
CUTOFF = 25.74
FEATURES = list(FLOORS)
_STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _bind(value: Column, body) -> Column:
    """``body`` of ``value`` evaluated once, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(hashes: Column) -> Column:
    """Words covered by WINDOW-word windows that occur twice or more among the word hashes of a text."""
    windows = F.transform(F.sequence(F.lit(1), F.size(hashes) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(hashes, i, F.lit(WINDOW))))

    def covered(pairs: Column) -> Column:
        # pairs (hash, start) in order: a window repeats if a neighbour has its hash
        n = F.size(pairs)

        def repeats(i: Column) -> Column:
            h = F.get(pairs, i)["h"]
            return F.coalesce(F.get(pairs, i - 1)["h"] == h, F.lit(False)) | F.coalesce(F.get(pairs, i + 1)["h"] == h, F.lit(False))

        starts = F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), n - 1), repeats), lambda i: F.get(pairs, i)["i"]))
        return _bind(starts, lambda s: F.when(F.size(s) == 0, F.lit(0)).otherwise(F.aggregate(F.sequence(F.lit(0), F.size(s) - 1), F.lit(0), lambda total, i: total + F.least(F.lit(WINDOW), F.coalesce(F.get(s, i + 1) - F.get(s, i), F.lit(WINDOW))))))

    def counted(w: Column) -> Column:
        paired = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(_bind(paired, covered))

    return F.when(F.size(hashes) < WINDOW, F.lit(0)).otherwise(_bind(windows, counted))


def with_statistics(df: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """``df`` with the statistics of each whole text and ``base_failed``; a null text has no words.

    n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines
    with a word that equal an earlier line), n_repeat_words.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    words = F.filter(F.split(text, _WS), lambda w: w != "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.translate(x, common.SPACES, "") != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    measured = _bind(hashes, lambda h: F.struct(F.size(h).cast("long").alias("n_words"), _repeat_words(h).cast("long").alias("n_repeat_words")))
    out = df.withColumn(f"{prefix}m", measured)
    n_words, n_repeat = F.col(f"{prefix}m.n_words"), F.col(f"{prefix}m.n_repeat_words")
    out = out.withColumns(
        {
            f"{prefix}n_words": n_words,
            f"{prefix}word_chars": F.char_length(F.translate(text, common.SPACES, "")).cast("long"),
            f"{prefix}n_symbols": (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long"),
            f"{prefix}n_dup_lines": _bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
            f"{prefix}n_repeat_words": n_repeat,
            f"{prefix}base_failed": (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT_PERCENT * n_words),
        }
    )
    return out.drop(f"{prefix}m")


def features(prefix: str = "") -> dict[str, Column]:
    """The transformed statistics: logarithms and square roots that bring long tails in."""

    def c(name: str) -> Column:
        return F.col(f"{prefix}{name}").cast("double")

    return {
        "log_words": F.log1p(c("n_words")),
        "word_length": c("word_chars") / F.greatest(c("n_words"), F.lit(1.0)),
        "symbols": F.sqrt(c("n_symbols") / F.greatest(c("word_chars"), F.lit(1.0))) * 4,
        "dup_lines": F.log1p(c("n_dup_lines")),
        "repeats": F.sqrt(c("n_repeat_words") / F.greatest(c("n_words"), F.lit(1.0))) * 4,
    }


def _inverse_expr(p: int) -> list[tuple[str, Column]]:
    """Columns that invert the symmetric matrix s_i_j by Cholesky's method: l_i_j, then the inverse factor t_i_j."""
    out: list[tuple[str, Column]] = []
    for j in range(p):
        total = F.col(f"s_{j}_{j}") - sum((F.col(f"l_{j}_{k}") * F.col(f"l_{j}_{k}") for k in range(j)), F.lit(0.0))
        out.append((f"l_{j}_{j}", F.sqrt(F.greatest(total, F.lit(1e-9)))))
        for i in range(j + 1, p):
            total = F.col(f"s_{i}_{j}") - sum((F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}") for k in range(j)), F.lit(0.0))
            out.append((f"l_{i}_{j}", total / F.col(f"l_{j}_{j}")))
    for j in range(p):
        out.append((f"t_{j}_{j}", 1 / F.col(f"l_{j}_{j}")))
        for i in range(j + 1, p):
            total = sum((F.col(f"l_{i}_{k}") * F.col(f"t_{k}_{j}") for k in range(j, i)), F.lit(0.0))
            out.append((f"t_{i}_{j}", -total / F.col(f"l_{i}_{i}")))
    return out


def _distance(c: Column, t: Column, values: list[Column]) -> Column:
    """Squared Mahalanobis distance: the length of the inverse factor times the centred vector."""
    p, total = len(values), F.lit(0.0)
    for i in range(p):
        row = sum((t[i * p + j] * (values[j] - c[j]) for j in range(i + 1)), F.lit(0.0))
        total = total + row * row
    return total


def _factored(df: DataFrame, cells: dict[tuple[int, int], Column], keep: list[str]) -> DataFrame:
    """``keep``, t (inverse Cholesky factor, by rows) and det (logarithm of the determinant) of the symmetric matrix ``cells``."""
    p = 1 + max(i for i, _ in cells)
    df = df.select(*keep, *[v.alias(f"s_{i}_{j}") for (i, j), v in cells.items()])
    for name, value in _inverse_expr(p):
        df = df.withColumn(name, value)
    t = F.array(*[F.col(f"t_{i}_{j}") if j <= i else F.lit(0.0) for i in range(p) for j in range(p)])
    det = sum((2 * F.log(f"l_{i}_{i}") for i in range(p)), F.lit(0.0))
    return df.select(*keep, t.alias("t"), det.alias("det"))


def _half(n: Column, p: int) -> Column:
    """Rows in the estimate of ``n`` rows."""
    return F.least(n, F.floor((n + p + 1) / 2))


def _consistency(share: float, p: int) -> float:
    """share / P(chi2 with p + 2 degrees <= the share quantile of chi2 with p degrees)."""

    def below(x: float, k: int) -> float:
        # regularised lower incomplete gamma by its series
        a, z = k / 2, x / 2
        term = total = 1 / a
        for n in range(1, 500):
            term *= z / (a + n)
            total += term
        return total * math.exp(-z + a * math.log(z) - math.lgamma(a))

    lo, hi = 1e-6, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid, p) < share else (lo, mid)
    return share / below(lo, p + 2)


def _shortest_half(q: Column) -> Column:
    """(width, middle) of the shortest interval between percentiles ``q`` (0 to 100) that are 50 apart."""
    return _bind(q, lambda q: F.array_min(F.transform(F.sequence(F.lit(0), F.lit(50)), lambda i: F.struct((F.get(q, i + 50) - F.get(q, i)).alias("width"), ((F.get(q, i + 50) + F.get(q, i)) / 2).alias("middle")))))


def _levels(rows: DataFrame, names: list[str]) -> DataFrame:
    """``rows`` once for each level, with level, k and a text ``id`` of both: k is the group, at the level of languages its field ``lang`` alone, for all rows null."""
    kind = rows.schema["g"].dataType
    keys = {GROUP: F.col("g"), WHOLE: F.lit(None).cast(kind)}
    if isinstance(kind, T.StructType) and "lang" in kind.names:
        keys[LANGUAGE] = F.struct(*[F.col("g.lang") if f.name == "lang" else F.lit(None).cast(f.dataType).alias(f.name) for f in kind])
    places = F.explode(F.array(*[F.struct(F.lit(level).alias("level"), k.alias("k")) for level, k in keys.items()]))
    return rows.select(places.alias("g"), *names).select(F.to_json("g").alias("id"), "g.level", "g.k", *names)


def _starts(both: DataFrame, floors: dict[str, float]) -> DataFrame:
    """(id, start, c, t, det): three starts for each group around the middles of the shortest halves of its statistics."""
    names, p = list(floors), len(floors)
    spread = both.groupBy("id").agg(*[_shortest_half(F.percentile_approx(a, [i / 100 for i in range(101)], 1000)).alias(a) for a in names])
    scales = F.array(*[F.sqrt(F.greatest((F.col(a)["width"] / 1.349) ** 2, F.lit(floors[a] ** 2))) for a in names])
    spread = common.stage(spread.select("id", F.array(*[F.col(a)["middle"] for a in names]).alias("c"), scales.alias("scale")), "spread")
    scored = both.join(common.small(spread), "id").select("id", *[((F.col(a) - F.col("c")[i]) / F.col("scale")[i]).alias(f"z_{i}") for i, a in enumerate(names)])
    size = sum((F.col(f"z_{i}") ** 2 for i in range(p)), F.lit(1e-9))
    flat = [F.tanh(f"z_{i}") for i in range(p)]
    sums = [F.avg(x).alias(f"m_{i}") for i, x in enumerate(flat)]
    sums += [F.avg(flat[i] * flat[j]).alias(f"q_{i}_{j}") for i in range(p) for j in range(i + 1)]
    sums += [F.avg(F.col(f"z_{i}") * F.col(f"z_{j}") / size).alias(f"v_{i}_{j}") for i in range(p) for j in range(i + 1)]
    found = scored.groupBy("id").agg(*sums).join(spread, "id")

    def cov(i: int, j: int) -> Column:
        return F.col(f"q_{i}_{j}") - F.col(f"m_{i}") * F.col(f"m_{j}") + (1e-6 if i == j else 0.0)

    def scatter(start: int, i: int, j: int) -> Column:
        if start == 0 or (start == 1 and i == j):
            return F.lit(float(i == j))
        if start == 1:
            return 0.999 * cov(i, j) / F.sqrt(cov(i, i) * cov(j, j))
        return F.col(f"v_{i}_{j}") + (1e-3 if i == j else 0.0)

    out = None
    for start in range(3):
        cells = {(i, j): scatter(start, i, j) * F.col("scale")[i] * F.col("scale")[j] for i in range(p) for j in range(i + 1)}
        made = _factored(found.withColumn("start", F.lit(start)), cells, ["id", "start", "c"])
        out = made if out is None else out.unionByName(made)
    return common.stage(out, "model")


def _step(both: DataFrame, model: DataFrame, floors: dict[str, float]) -> DataFrame:
    """A concentration step: (id, start, n, before, c, s, t, det) from the half of each group that is nearest by ``model``; ``before`` is the model's det, s the covariance."""
    names, p = list(floors), len(floors)
    near = both.join(common.small(model.select("id", "start", "c", "t", F.col("det").alias("before"))), "id")
    near = near.select("id", "start", "before", *names, _distance(F.col("c"), F.col("t"), [F.col(a) for a in names]).alias("d"))
    near = near.withColumn("bin", F.ceil(F.log(F.greatest(F.col("d"), F.lit(1e-6))) * BINS).cast("int"))
    counts = near.groupBy("id", "start", "bin").agg(F.count("*").alias("n"))
    # the histogram has some thousand bins at most, whatever the rows
    border = counts.groupBy("id", "start").agg(F.sort_array(F.collect_list(F.struct("bin", "n"))).alias("bins"), F.sum("n").alias("n"))
    border = border.withColumn("wanted", _half(F.col("n"), p))
    begin = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("int").alias("edge"), F.lit(None).cast("double").alias("share"))

    def upto(s: Column, x: Column) -> Column:
        after = s["n"] + x["n"]
        return F.when(s["edge"].isNotNull(), s).otherwise(F.struct(after.alias("n"), F.when(after >= F.col("wanted"), x["bin"]).alias("edge"), ((F.col("wanted") - s["n"]) / x["n"]).alias("share")))

    border = common.stage(border.select("id", "start", "n", F.aggregate("bins", begin, upto).alias("e")).select("id", "start", "n", "e.edge", "e.share"), "border")
    inner = near.join(common.small(border), ["id", "start"]).where(F.col("bin") <= F.col("edge"))
    w = F.when(F.col("bin") < F.col("edge"), 1.0).otherwise(F.col("share"))
    sums = [F.sum(w).alias("h"), F.max("n").alias("n"), F.max("before").alias("before")]
    sums += [F.sum(w * F.col(a)).alias(f"m_{i}") for i, a in enumerate(names)]
    sums += [F.sum(w * F.col(names[i]) * F.col(names[j])).alias(f"q_{i}_{j}") for i in range(p) for j in range(i + 1)]
    made = inner.groupBy("id", "start").agg(*sums)
    made = made.withColumns({f"c_{i}": F.col(f"m_{i}") / F.col("h") for i in range(p)})
    # the covariance of the inner half is scaled up to that of the whole by its consistency factor
    grow = _consistency(HALF, p)
    cells = {(i, j): (F.col(f"q_{i}_{j}") / F.col("h") - F.col(f"c_{i}") * F.col(f"c_{j}")) * grow for i in range(p) for j in range(i + 1)}
    # a floor is a minimum: it leaves variances above it as they are
    cells |= {(i, i): F.greatest(cells[i, i], F.lit(floors[a] ** 2)) for i, a in enumerate(names)}
    s = F.array(*[cells[max(i, j), min(i, j)] for i in range(p) for j in range(p)])
    made = made.select("id", "start", "n", "before", F.array(*[F.col(f"c_{i}") for i in range(p)]).alias("c"), s.alias("s"))
    return common.stage(_factored(made, {(i, j): F.col("s")[i * p + j] for i, j in cells}, ["id", "start", "n", "before", "c", "s"]), "model")


def _drawn(own: DataFrame, parent: DataFrame, on: Column, p: int, prior: float) -> DataFrame:
    """Estimates mixed with their parents' by numbers of rows: centre and covariance of the mixture."""
    side = parent.select(F.col("k").alias("pk"), F.col("c").alias("pc"), F.col("s").alias("ps"))
    a = F.col("share")
    joined = own.join(side, on).withColumn("share", F.col("n") / (F.col("n") + prior)).withColumn("d", F.zip_with("c", "pc", lambda x, y: x - y))
    c = F.zip_with("c", "pc", lambda x, y: a * x + (1 - a) * y)
    s = F.array(*[a * F.col("s")[i] + (1 - a) * F.col("ps")[i] + a * (1 - a) * F.col("d")[i // p] * F.col("d")[i % p] for i in range(p * p)])
    return joined.select("level", "k", "n", "share", c.alias("c"), s.alias("s"))


def fit(rows: DataFrame, floors: dict[str, float] = FLOORS, prior: float = PRIOR) -> DataFrame:
    """(level, k, n, share, c, t) for the groups of ``rows`` (g, one column per feature), their languages, and all rows.

    n counts the rows of the group itself and share is their part in the
    estimate, n / (n + ``prior``); the rest is the language's (which needs
    groups with a field ``lang``), and of a language all rows'. c is the centre,
    t the inverse Cholesky factor of the covariance, by rows.
    """
    names, p = list(floors), len(floors)
    both = common.stage(_levels(rows, names), "levels")
    model = _starts(both, floors)
    for _ in range(START_STEPS):
        model = _step(both, model, floors)
    best = model.groupBy("id").agg(F.min_by("start", F.struct("det", "start")).alias("start"))
    active = common.stage(model.join(best, ["id", "start"]), "model")
    falls, rest = F.col("before") - F.col("det") > SETTLED, []
    # every step lowers the determinants of those that go on, and floors bound them from below
    while not active.isEmpty():
        made = _step(both, active, floors)
        rest.append(made.where(~falls))
        active = made.where(falls)
    model = reduce(DataFrame.unionByName, rest, active)
    keys = both.select("id", "level", "k").distinct()
    raw = model.join(keys, "id").select("level", "k", "n", F.lit(1.0).alias("share"), "c", F.transform("s", lambda x: x * (1 + SMALL / (F.col("n") + prior))).alias("s"))
    raw = common.stage(raw, "model")
    whole, groups = raw.where(F.col("level") == WHOLE), raw.where(F.col("level") == GROUP)
    # one row of all rows
    parents, of = F.broadcast(whole), F.lit(True)
    out = whole
    if isinstance(rows.schema["g"].dataType, T.StructType) and "lang" in rows.schema["g"].dataType.names:
        parents, of = _drawn(raw.where(F.col("level") == LANGUAGE), F.broadcast(whole), F.lit(True), p, prior), F.col("k.lang").eqNullSafe(F.col("pk.lang"))
        out = out.unionByName(parents)
    out = out.unionByName(_drawn(groups, parents, of, p, prior))
    floor = [floors[a] ** 2 for a in names]
    cells = {(i, j): F.greatest(F.col("s")[i * p + i], F.lit(floor[i])) if i == j else F.col("s")[i * p + j] for i in range(p) for j in range(i + 1)}
    done = common.stage(_factored(out, cells, ["level", "k", "n", "share", "c", "s"]).drop("det", "s"), "model")
    common.drop(both)
    return done


def _grouped(df: DataFrame, lang_col: str, source_col: str, prefix: str) -> DataFrame:
    return df.withColumn(f"{prefix}g", F.struct(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{source_col}`").cast("string").alias("source")))


def _rows(stats: DataFrame, prefix: str) -> DataFrame:
    """What the estimates are made of: group and features of the rows that pass the base limits."""
    return stats.where(f"NOT `{prefix}base_failed`").select(F.col(f"{prefix}g").alias("g"), *[v.alias(k) for k, v in features(prefix).items()])


def judge(df: DataFrame, model: DataFrame, prefix: str, cutoff: float = CUTOFF) -> DataFrame:
    """``df`` (with statistics and group) with ``distance2``, ``share`` and ``kept``, from its group's model; a group without passing rows has its language's, or that of all rows.

    ``share`` is the part of the group's own rows in its estimate.
    """
    own = common.Names(df)
    names = [own(x) for x in ("group", "lang", "whole")]
    cut = [F.struct("c", "t", "share").alias(n) for n in names]
    keys = own("k"), own("l"), own("one")
    at = [model.where(F.col("level") == level) for level in (GROUP, LANGUAGE, WHOLE)]
    at[:2] = [common.small(x) for x in at[:2]]
    out = df.join(at[0].select(F.col("k").alias(keys[0]), cut[0]), F.col(f"{prefix}g").eqNullSafe(F.col(keys[0])), "left")
    out = out.join(at[1].select(F.struct("k.lang").alias(keys[1]), cut[1]), F.struct(f"{prefix}g.lang").eqNullSafe(F.col(keys[1])), "left")
    # one row: the model of all rows
    out = out.join(F.broadcast(at[2].select(cut[2])), F.lit(True), "left")
    chosen = own("model")
    out = out.withColumn(chosen, F.coalesce(*[F.col(n) for n in names]))
    d = _distance(F.col(chosen)["c"], F.col(chosen)["t"], list(features(prefix).values()))
    out = out.withColumn(f"{prefix}share", F.coalesce(F.col(names[0])["share"], F.lit(0.0))).withColumn(f"{prefix}distance2", d)
    kept = ~F.col(f"{prefix}base_failed") & F.coalesce(F.col(f"{prefix}distance2") <= cutoff, F.lit(True))
    return out.withColumn(f"{prefix}kept", kept).drop(*names, *keys, chosen)


def quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(id, the statistics, base_failed, distance2, share, kept) for each row; ``share`` is the part of the group's own rows in the estimate that judged it.

    Null languages and sources are values of their own. Rows that fail the base
    limits take no part in the estimates. Repeated rows and null ids stay; other
    columns, whatever their names, are left out; an empty table gives no rows; a
    table without passing rows has no estimate and keeps none.
    """
    x = "__q_"
    stats = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{source_col}`").alias("source"), F.col(f"`{text_col}`").alias("text"))
    stats = common.stage(_grouped(with_statistics(stats, "text", x).drop("text"), "lang", "source", x).drop("lang", "source"), "stats")
    done = judge(stats, fit(_rows(stats, x)), x)
    return done.select("id", *[F.col(f"{x}{c}").alias(c) for c in [*_STATS, "base_failed", "distance2", "share", "kept"]])


def keep_good(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of ``df`` that are kept, with all their columns, whatever their names.

    Rows are staged once with their statistics, which are dear; the estimate and
    the verdict read them from there, and nothing is shuffled by row.
    """
    x, names = common.Names(df).prefix("q"), df.columns
    stats = common.stage(_grouped(with_statistics(df, text_col, x), lang_col, source_col, x), "stats")
    done = judge(stats, fit(_rows(stats, x)), x)
    return done.where(f"`{x}kept`").select(*[F.col(f"`{c}`") for c in names])
