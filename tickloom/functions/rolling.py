"""Column expressions over the last n bars of a panel.

A value exists only when the frame holds n non-null inputs, as in pandas.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.expr import col, ratio
from tickloom.operators.panel import back, lagged


def roll(agg: Callable[[Column], Column], c, n: int) -> Column:
    c, w = col(c), back(n)
    return F.when(F.count(c).over(w) >= n, agg(c).over(w))


def sma(c, n):
    return roll(F.avg, c, n)


def rsum(c, n):
    return roll(F.sum, c, n)


def rmax(c, n):
    return roll(F.max, c, n)


def rmin(c, n):
    return roll(F.min, c, n)


def rstd(c, n):
    """Sample standard deviation."""
    return roll(F.stddev_samp, c, n)


def rstd_pop(c, n):
    return roll(F.stddev_pop, c, n)


# kind -> what is merged; means and deviations are merged without subtraction of sums
FAMILY = {"sum": "sum", "min": "min", "max": "max", "mean": "mean", "std": "moments", "std_pop": "moments", "skewness": "shape", "kurtosis": "shape", "corr": "pair"}


def _first(family: str, x: Column) -> Column:
    """State of one bar. A pair is a struct (x, y), NULL in both where one is missing."""
    if family in ("min", "max"):
        return x
    if family == "pair":
        a, b = x["x"].cast("double"), x["y"].cast("double")
        zero = a * 0.0 + b * 0.0
        return F.struct(a.alias("x"), b.alias("y"), zero.alias("xx"), zero.alias("yy"), zero.alias("xy"))
    x = x.cast("double")
    names = {"moments": ("m2",), "shape": ("m2", "m3", "m4")}.get(family)
    return x if names is None else F.struct(x.alias("mean"), *[(x * 0.0).alias(m) for m in names])


def _merge(family: str, new: Column, k: int, old: Column, m: int) -> Column:
    """State of k + m neighbouring bars from those of the newer k and the older m.

    A part without all its values is NULL and so is what is merged from it.
    """
    if family == "sum":
        return new + old
    if family in ("min", "max"):
        pick = F.least if family == "min" else F.greatest
        return F.when(new.isNotNull() & old.isNotNull(), pick(new, old))
    if family == "mean":
        return new + (old - new) * (m / (k + m))
    n = k + m
    if family == "pair":
        dx, dy = old["x"] - new["x"], old["y"] - new["y"]
        return F.struct(
            (new["x"] + dx * (m / n)).alias("x"),
            (new["y"] + dy * (m / n)).alias("y"),
            (new["xx"] + old["xx"] + dx * dx * (k * m / n)).alias("xx"),
            (new["yy"] + old["yy"] + dy * dy * (k * m / n)).alias("yy"),
            (new["xy"] + old["xy"] + dx * dy * (k * m / n)).alias("xy"),
        )
    gap = old["mean"] - new["mean"]
    mean = (new["mean"] + gap * (m / n)).alias("mean")
    m2 = (new["m2"] + old["m2"] + gap * gap * (k * m / n)).alias("m2")
    if family == "moments":
        return F.struct(mean, m2)
    m3 = new["m3"] + old["m3"] + gap * gap * gap * (k * m * (k - m) / n**2) + gap * (k * old["m2"] - m * new["m2"]) * (3 / n)
    m4 = (
        new["m4"]
        + old["m4"]
        + gap * gap * gap * gap * (k * m * (k * k - k * m + m * m) / n**3)
        + gap * gap * (k * k * old["m2"] + m * m * new["m2"]) * (6 / n**2)
        + gap * (k * old["m3"] - m * new["m3"]) * (4 / n)
    )
    return F.struct(mean, m2, m3.alias("m3"), m4.alias("m4"))


def sliding(df: DataFrame, specs: dict[str, tuple[str, str, int]]) -> DataFrame:
    """Add values over the last n bars; specs: name -> (kind, column, n).

    A frame of n bars is put together from disjoint parts of 1, 2, 4, ... bars, each made
    from two of the next smaller ones by one ``lag``, so a frame costs log(n) steps a bar
    and not n. All lengths over a column share the parts. Minimum and maximum overlap two
    parts. On constant stretches means are exact and deviations 0; skewness, kurtosis and
    correlation (``corr`` of a struct column x, y) are NULL there.
    """
    asked: dict[tuple[str, str], set[int]] = {}
    for kind, c, n in specs.values():
        asked.setdefault((FAMILY[kind], c), set()).add(n)
    for family, c in list(asked):
        if family == "mean" and ("moments", c) in asked:
            asked["moments", c] |= asked.pop((family, c))

    def part(g, k):
        return f"_part_{g[0]}_{g[1]}_{k}"

    def at(g, k, shift=0):
        return lagged(part(g, k), shift) if shift else F.col(part(g, k))

    made = []
    level = {}
    for g in asked:
        level[part(g, 1)] = _first(g[0], F.col(g[1]))
    k = 1
    while level:
        df = df.withColumns(level)
        made += level
        level = {part(g, 2 * k): _merge(g[0], at(g, k), k, at(g, k, k), k) for g, lengths in asked.items() if max(lengths) >= 2 * k}
        k *= 2

    # the parts of each length, from the newest on: (bars, shift)
    frames: dict[tuple, list[tuple[int, int]]] = {}
    for g, lengths in asked.items():
        for n in lengths:
            top = 1 << (n.bit_length() - 1)
            if g[0] in ("min", "max"):
                frames[g, n] = [(top, 0), (top, n - top)] if n > top else [(top, 0)]
            else:
                bits = [b for b in (1 << i for i in range(n.bit_length() - 1, -1, -1)) if n & b]
                frames[g, n] = [(b, sum(bits[:i])) for i, b in enumerate(bits)]
    moved = {f"{part(g, b)}_{shift}": at(g, b, shift) for (g, _), parts in frames.items() for b, shift in parts if shift}
    df = df.withColumns(moved) if moved else df
    made += moved
    for step in range(1, max(len(p) for p in frames.values())):
        level = {}
        for (g, n), parts in frames.items():
            if len(parts) > step:
                b, shift = parts[step]
                old = at(g, parts[0][0]) if step == 1 else F.col(f"_frame_{g[0]}_{g[1]}_{n}_{step - 1}")
                level[f"_frame_{g[0]}_{g[1]}_{n}_{step}"] = _merge(g[0], old, shift, F.col(f"{part(g, b)}_{shift}"), b)
        df = df.withColumns(level)
        made += level

    def value(kind, c, n):
        g = (FAMILY[kind], c)
        if g not in asked:
            g = ("moments", c)
        last = len(frames[g, n]) - 1
        v = F.col(f"_frame_{g[0]}_{g[1]}_{n}_{last}") if last else at(g, n)
        if kind == "mean":
            return v["mean"] if g[0] == "moments" else v
        if kind in ("std", "std_pop"):
            count = n if kind == "std_pop" else n - 1
            return F.sqrt(v["m2"] / count) if count else F.lit(None).cast("double")
        if kind == "skewness":
            return ratio(n**0.5 * v["m3"], F.sqrt(v["m2"] * v["m2"] * v["m2"]))
        if kind == "kurtosis":
            return ratio(n * v["m4"], v["m2"] * v["m2"]) - 3
        if kind == "corr":
            return ratio(v["xy"], F.sqrt(v["xx"]) * F.sqrt(v["yy"]))
        return v

    return df.withColumns({name: value(*spec) for name, spec in specs.items()}).drop(*made)


def rzscore(c, n):
    return ratio(col(c) - sma(c, n), rstd(c, n))


def rcorr(a, b, n):
    """Pearson correlation; NULL where one side is constant."""
    a, b, w = col(a), col(b), back(n)
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    spread = F.stddev_pop(x).over(w) * F.stddev_pop(y).over(w)
    return F.when(F.count(x).over(w) >= n, ratio(F.covar_pop(x, y).over(w), spread))


def rlist(c, n):
    """The last n values as an array (bounded), NULL until there are n."""
    return roll(F.collect_list, c, n)


def rank_in(arr: Column, x: Column) -> Column:
    """Average-tie percent rank of x among the elements of arr, in (0, 1]."""
    below = F.size(F.filter(arr, lambda v: v < x))
    same = F.size(F.filter(arr, lambda v: v == x))
    return F.when(arr.isNotNull() & x.isNotNull(), (below + (same + 1) / 2) / F.size(arr))


def rslope(c, n):
    """Least-squares slope per bar over the last n values."""
    c, w = col(c), back(n)
    return F.when(F.count(c).over(w) >= n, F.regr_slope(c, F.col("bar_no").cast("double")).over(w))


def streak_from(no, last_miss) -> Column:
    """Length of the current run, given the position of the last bar that broke it."""
    return col(no) - F.coalesce(col(last_miss), F.lit(-1))
