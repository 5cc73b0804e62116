"""Nonlinear least squares of model curves for many series at once.

Each round is one pass over the points: every series tries a few damped steps (Levenberg-Marquardt) at the same time, and
the squared errors and normal equations of all trials are grouped sums. A series' parameters are one row, so a series may have any
number of points in any number of tasks. Series that have converged leave the pass.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowgrid.functions import exact
from flowgrid.functions.storage import discard, materialize

#: Factors on a series' damping that are tried in one pass.
TRIALS = (0.1, 1.0, 30.0, 1e4)
#: A step that lowers the error by less than this share ends the search, and so does a damping beyond which steps vanish.
SETTLED, STIFF = 1e-11, 1e13
#: Step of the differences that stand for derivatives, as a share of the parameter.
STEP = 1e-6
_P = ("a", "b", "c")
_PAIRS = [(i, j) for i in range(3) for j in range(i, 3)]


def _log_gamma(z: Column) -> Column:
    """Stirling's series eight steps up, where it is exact to rounding, less the logarithms of the steps."""
    up = z + 8
    steps = reduce(lambda s, k: s + F.ln(z + k), range(1, 8), F.ln(z))
    series = 1 / (12 * up) - 1 / (360 * F.pow(up, 3)) + 1 / (1260 * F.pow(up, 5))
    return (up - 0.5) * F.ln(up) - up + 0.9189385332046727 + series - steps


def _power(x, a, b, c):
    return a * F.pow(x, b)


def _exponential(x, a, b, c):
    return a * F.exp(F.least(b * x, F.lit(300.0)))


def _linear(x, a, b, c):
    return a + b * x


def _lognormal(x, a, b, c):
    return a * F.exp(-F.pow((F.ln(x) - b) / c, 2) / 2) / (x * c * 2.5066282746310002)


def _gamma(x, a, b, c):
    return a * F.exp((b - 1) * F.ln(x) - x / c - _log_gamma(b) - b * F.ln(c))


def _weibull(x, a, b, c):
    return a * b / c * F.pow(x / c, b - 1) * F.exp(-F.pow(x / c, b))


#: The curve, its number of parameters, whether x has to be above 0, and which parameters have to be.
MODELS = {
    "power": (_power, 2, True, ()), "exponential": (_exponential, 2, False, ()), "linear": (_linear, 2, False, ()),
    "lognormal": (_lognormal, 3, True, ("c",)), "gamma": (_gamma, 3, True, ("b", "c")), "weibull": (_weibull, 3, True, ("b", "c")),
}


def _of_model(pick) -> Column:
    """The column that ``pick`` gives for the row's model."""
    first, *rest = MODELS.items()
    return reduce(lambda w, m: w.when(F.col("model") == m[0], pick(m[0], *m[1])), rest, F.when(F.col("model") == first[0], pick(first[0], *first[1])))


def _values() -> Column:
    """The curve at the trial's parameters, and with each of them a step up and a step down; null where it has no value.

    One expression inside a lambda, so that the formulas are in the plan once.
    """
    shifts = [[0.0] * 3] + [[sign if i == k else 0.0 for i in range(3)] for k in range(3) for sign in (1.0, -1.0)]
    places = F.array(*[F.struct(*[(F.col(f"t_{p}") + s * F.col(f"h_{p}")).alias(p) for p, s in zip(_P, shift)]) for shift in shifts])

    def curve(at: Column) -> Column:
        guarded = lambda name, f, n, above, positive: F.when(reduce(Column.__and__, [at[p] > 0 for p in positive], F.lit(True)), f(F.col("x"), *[at[p] for p in _P]))
        return _of_model(guarded)

    return F.transform(F.transform(places, curve), lambda v: F.when(~F.isnan(v) & (F.abs(v) < 1e150), v))


def _pass(points: DataFrame, trials: DataFrame) -> DataFrame:
    """For each series, model and trial: n, loss, normal matrix and gradient."""
    rows = points.join(trials, "series").filter(_of_model(lambda name, f, n, above, positive: (F.col("x") > 0) if above else F.lit(True)))
    rows = rows.withColumns({f"h_{p}": F.greatest(F.abs(f"t_{p}"), F.lit(1e-3)) * STEP for p in _P})
    rows = rows.withColumn("v", _values())
    # a parameter that the model doesn't have moves nothing
    slope = lambda k: F.when(F.lit(k) < F.col("size"), (F.col("v")[2 * k + 1] - F.col("v")[2 * k + 2]) / (2 * F.col(f"h_{_P[k]}"))).otherwise(F.lit(0.0))
    slopes = {f"j{k}": slope(k) for k in range(3)}
    rows = rows.withColumns({"r": F.col("y") - F.col("v")[0]} | slopes)
    bad = reduce(Column.__or__, [F.col(k).isNull() for k in ("r", *slopes)])
    sums = [F.sum(F.col(f"j{i}") * F.col(f"j{j}")).alias(f"h{i}{j}") for i, j in _PAIRS] + [F.sum(F.col(f"j{i}") * F.col("r")).alias(f"g{i}") for i in range(3)]
    keys = ["series", "model", "size", "trial", "t_a", "t_b", "t_c", "damp"]
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.max(bad).alias("bad"), F.sum(F.col("r") * F.col("r")).alias("loss"), F.sum(F.col("y") * F.col("y")).alias("size_y"), *sums)


def _solved(factor: Column) -> dict[str, Column]:
    """The three parameters after a step with the damping times ``factor``: Cramer's rule on the damped normal equations, in units of their diagonal."""
    scale = [F.sqrt(F.when(F.col(f"h{i}{i}") > 0, F.col(f"h{i}{i}")).otherwise(F.lit(1.0))) for i in range(3)]
    m = {}
    for i, j in _PAIRS:
        v = F.col(f"h{i}{j}") / (scale[i] * scale[j])
        m[i, j] = m[j, i] = (F.lit(1.0) + F.col("damp") * factor) if i == j else v
    g = [F.col(f"g{i}") / scale[i] for i in range(3)]

    def det(a):
        return a[0][0] * (a[1][1] * a[2][2] - a[1][2] * a[2][1]) - a[0][1] * (a[1][0] * a[2][2] - a[1][2] * a[2][0]) + a[0][2] * (a[1][0] * a[2][1] - a[1][1] * a[2][0])

    rows = [[m[i, j] for j in range(3)] for i in range(3)]
    whole = det(rows)
    steps = [F.try_divide(det([[g[i] if j == k else rows[i][j] for j in range(3)] for i in range(3)]), whole) / scale[k] for k in range(3)]
    return {f"t_{p}": F.col(p) + F.coalesce(s, F.lit(0.0)) for p, s in zip(_P, steps)}


def _starts(points: DataFrame, models: list[str]) -> DataFrame:
    """First parameters: lines through logarithms, moments of x weighted by y; the amplitude of densities is one of theirs by area."""
    log = lambda c: F.when(F.col(c) > 0, F.ln(c))
    lines = {"power": (log("y"), log("x")), "exponential": (log("y"), F.col("x")), "linear": (F.col("y"), F.col("x"))}
    by_line = exact.fit_lines(points, ["series"], lines)
    w, lx = F.greatest("y", F.lit(0.0)), log("x")
    sums = {"w": F.sum(F.when(F.col("x") > 0, w)), "m": F.sum(F.when(F.col("x") > 0, w * F.col("x"))), "v": F.sum(F.when(F.col("x") > 0, w * F.col("x") * F.col("x"))), "l": F.sum(w * lx), "q": F.sum(w * lx * lx)}
    wide = F.try_divide(F.max("x") - F.min("x"), F.count("*") - 1)
    s = points.groupBy("series").agg(*[c.alias(f"_{k}") for k, c in sums.items()], wide.alias("_wide")).join(by_line, "series")
    mean, log_mean = F.try_divide("_m", "_w"), F.try_divide("_l", "_w")
    spread = lambda square, mid: F.greatest(F.try_divide(square, "_w") - mid * mid, F.lit(1e-9))
    var, log_sd = spread("_v", mean), F.sqrt(spread("_q", log_mean))
    area, shape = F.col("_w") * F.col("_wide"), F.greatest(F.try_divide(mean, F.sqrt(var)), F.lit(0.3))
    either = lambda c, other: F.coalesce(c, F.lit(float(other)))
    first = {
        "power": (F.exp("intercept_power"), F.col("slope_power")), "exponential": (F.exp("intercept_exponential"), F.col("slope_exponential")), "linear": (F.col("intercept_linear"), F.col("slope_linear")),
        "lognormal": (area, log_mean, log_sd), "gamma": (area, mean * mean / var, var / mean), "weibull": (area, F.pow(shape, 1.086), mean / 0.9),
    }
    structs = [F.struct(F.lit(m).alias("model"), F.lit(MODELS[m][1]).alias("size"), *[either(first[m][k] if k < len(first[m]) else F.lit(0.0), (1, 0, 0)[k] if k >= len(first[m]) else 1).alias(f"t_{p}") for k, p in enumerate(_P)]) for m in models]
    return s.select("series", F.explode(F.array(*structs)).alias("s")).select("series", "s.*").withColumns({"trial": F.lit(0), "damp": F.lit(1e-3)})


def fit_curves(points: DataFrame, models: list[str], rounds: int = 40, by_sum: bool = True) -> DataFrame:
    """series, model, a, b, c, loss, n, rounds, converged: least squares of every model for every series.

    ``points``: series, x, y; rows without a value are left out, those with y = 0 count. ``by_sum`` divides a series' y by its sum. power:
    a x^b; exponential: a e^(b x); linear: a + b x; lognormal (mean b and deviation c of ln x), gamma (shape b, scale c) and weibull
    (shape b, scale c): a times the density; these and power use x > 0 only. c is null for models of two parameters. A series with fewer
    points than parameters, or that no first guess fits, has null parameters and isn't converged; so isn't one that still moves after ``rounds`` passes (it
    keeps the best parameters found).
    """
    rows = points.select("series", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).dropna()
    if by_sum:
        total = rows.groupBy("series").agg(F.sum("y").alias("_z"))
        rows = rows.join(total, "series").select("series", "x", F.try_divide("y", "_z").alias("y")).dropna()
    rows = materialize(rows, "series")
    keep = ["series", "model", "size", *_P, "damp", "loss", "size_y", "n", *[f"h{i}{j}" for i, j in _PAIRS], "g0", "g1", "g2"]
    start = _pass(rows, _starts(rows, models)).withColumns({p: F.col(f"t_{p}") for p in _P})
    lost = F.col("bad") | F.isnan("loss") | (F.col("n") < F.col("size"))
    now = materialize(start.select(*keep, lost.alias("lost")).withColumns({"rounds": F.lit(0), "done": F.col("lost") | (F.col("loss") <= 1e-26 * F.col("size_y"))}), "fits")
    factors = F.explode(F.array(*[F.struct(F.lit(i).alias("trial"), F.lit(f).alias("factor")) for i, f in enumerate(TRIALS)])).alias("f")
    for k in range(1, rounds + 1):
        open_ = now.filter("not done")
        if open_.isEmpty():
            break
        tried = open_.select("*", factors).select("*", "f.*").withColumns(_solved(F.col("factor"))).select("series", "model", "size", "trial", (F.col("damp") * F.col("factor")).alias("damp"), "t_a", "t_b", "t_c")
        found = _pass(rows, tried).filter(~F.col("bad") & ~F.isnan("loss"))
        new = found.withColumns({p: F.col(f"t_{p}") for p in _P}).select(*keep, "trial")
        best = new.groupBy("series", "model").agg(F.min_by(F.struct(*[c for c in keep if c not in ("series", "model")]), F.struct("loss", "trial")).alias("new"))
        both = open_.join(best, ["series", "model"], "left")
        better = F.coalesce(F.col("new.loss") < F.col("loss"), F.lit(False))
        gain = F.col("loss") - F.col("new.loss")
        step = {c: F.when(better, F.col(f"new.{c}")).otherwise(F.col(c)) for c in keep if c not in ("series", "model", "size", "damp")}
        damp = F.when(better, F.greatest(F.col("new.damp") / 3, F.lit(1e-15))).otherwise(F.col("damp") * TRIALS[-1])
        done = F.when(better, (gain <= SETTLED * F.col("loss")) | (F.col("new.loss") <= 1e-26 * F.col("size_y"))).otherwise(F.col("damp") * TRIALS[-1] > STIFF)
        stepped = both.select("series", "model", "size", *[c.alias(n) for n, c in step.items()], damp.alias("damp"), "lost", F.lit(k).alias("rounds"), done.alias("done"))
        old, now = now, materialize(now.filter("done").unionByName(stepped), "fits")
        discard(old)
    discard(rows)
    out = now
    known = lambda p: F.when(~F.col("lost") & (F.lit(_P.index(p)) < F.col("size")), F.col(p)).alias(p)
    return out.select("series", "model", *[known(p) for p in _P], F.when(~F.col("lost"), F.col("loss")).alias("loss"), "n", "rounds", (F.col("done") & ~F.col("lost")).alias("converged"))
