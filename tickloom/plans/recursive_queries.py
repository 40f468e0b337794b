"""Registered queries: recursive features and candle patterns."""

from __future__ import annotations

from tickloom.operators import scan
from tickloom.operators.panel import settle
from tickloom.plans.datasets import finish
from tickloom.plans.feature_queries import _tr, ev, sup
from tickloom.plans.registry import query
from tickloom.plans.sql import EVENT, SUPPLY, Sql, div, ema, flag, lag

SPANS = (5, 10, 12, 20, 26, 50, 100, 200)


@query(
    "ema_weighted",
    Sql(SUPPLY)
    .number()
    .step(**{f"ema_{n}": ema("close", n, "weighted") for n in SPANS})
    .step(
        **{f"price_ema_{n}_ratio": div("close", f"ema_{n}") for n in SPANS},
    )
    .step(
        ema_cross_12_26=flag("ema_12 > ema_26"),
        above_ema_200=flag("close > ema_200"),
        trend_strength="abs(price_ema_20_ratio - 1) * 100",
        trend_direction="CAST(sign(price_ema_20_ratio - 1) AS INTEGER)",
    )
    .out(" ".join([f"ema_{n}" for n in SPANS] + [f"price_ema_{n}_ratio" for n in SPANS]) + " trend_strength", "ema_cross_12_26 above_ema_200 trend_direction", digits=4),
)
def q_ema(spark, sf):
    d = scan.ema_context(scan.emas(sup(spark, sf, 0, scans=True), SPANS))
    return finish(settle(d), *[f"ema_{n}" for n in SPANS], *[f"price_ema_{n}_ratio" for n in SPANS], "trend_strength", "ema_cross_12_26", "above_ema_200", "trend_direction", digits=4)


@query(
    "ema_seeds",
    Sql(EVENT)
    .number()
    .step(**{f"{s}_{n}": ema("close", n, s) for s in ("first", "mean") for n in (12, 50, 200)})
    .out("first_12 first_50 first_200 mean_12 mean_50 mean_200"),
)
def q_ema_seeds(spark, sf):
    d = scan.scan(ev(spark, sf, 0, scans=True), [scan.Ema(f"{s}_{n}", "close", n, s) for s in ("first", "mean") for n in (12, 50, 200)])
    return finish(settle(d), "first_12", "first_50", "first_200", "mean_12", "mean_50", "mean_200")


@query(
    "macd_first",
    Sql(SUPPLY)
    .number()
    .step(macd=f"{ema('close', 12)} - {ema('close', 26)}")
    .step(macd_signal=ema("macd", 9))
    .step(macd_hist="macd - macd_signal", macd_cross=flag("round(macd, 9) > round(macd_signal, 9)"))
    .out("macd macd_signal macd_hist", digits=4),
)
def q_macd(spark, sf):
    return finish(settle(scan.macd(sup(spark, sf, 0, scans=True))), "macd", "macd_signal", "macd_hist", digits=4)


@query(
    "macd_mean_seed",
    Sql(EVENT)
    .number()
    .step(_m=f"{ema('close', 12, 'mean', 14)} - {ema('close', 26, 'mean')}")
    .step(macd_signal=ema("_m", 9, "mean", 25))
    .step(macd="CASE WHEN macd_signal IS NOT NULL THEN _m END")
    .step(macd_hist="macd - macd_signal", macd_cross=flag("macd > macd_signal"))
    .out("macd macd_signal macd_hist", "macd_cross"),
)
def q_macd_mean(spark, sf):
    return finish(settle(scan.macd(ev(spark, sf, 0, scans=True), seed="mean")), "macd", "macd_signal", "macd_hist", "macd_cross")


RS = (7, 14, 21, 50)


@query(
    "rsi_wilder",
    Sql(EVENT)
    .number()
    .step(_d=f"close - {lag('close')}")
    .step(_g="greatest(_d, 0)", _x="greatest(-_d, 0)")
    .step(**{f"_u{n}": ema("_g", n, "mean", 1, True) for n in RS}, **{f"_d{n}": ema("_x", n, "mean", 1, True) for n in RS})
    .step(**{f"rsi_{n}": f"CASE WHEN _u{n} + _d{n} = 0 THEN 0 ELSE 100 * _u{n} / (_u{n} + _d{n}) END" for n in RS})
    .out(" ".join(f"rsi_{n}" for n in RS)),
)
def q_rsi(spark, sf):
    return finish(settle(scan.rsi(ev(spark, sf, 1, scans=True), RS)), *[f"rsi_{n}" for n in RS])


@query(
    "atr_wilder",
    Sql(EVENT)
    .number()
    .step(_p=lag("close"), _t=_tr)
    .step(_tr="CASE WHEN _p IS NOT NULL THEN _t END")
    .step(**{f"atr_{n}": ema("_tr", n, "mean", 1, True) for n in RS})
    .out(" ".join(f"atr_{n}" for n in RS)),
)
def q_atr(spark, sf):
    return finish(settle(scan.atr(ev(spark, sf, 1, scans=True), RS)), *[f"atr_{n}" for n in RS])


@query(
    "adx",
    Sql(EVENT)
    .number()
    .step(_p=lag("close"), _t=_tr, _up=f"high - {lag('high')}", _dn=f"{lag('low')} - low")
    .step(_tr="CASE WHEN _p IS NOT NULL THEN _t END", _pdm="CASE WHEN _up > _dn AND _up > 0 THEN _up ELSE 0 END", _mdm="CASE WHEN _dn > _up AND _dn > 0 THEN _dn ELSE 0 END")
    .step(_a=ema("_tr", 14, "mean", 1, True), _b=ema("_pdm", 14, "mean", 1, True), _c=ema("_mdm", 14, "mean", 1, True))
    .step(plus_di="100 * " + div("_b", "_a"), minus_di="100 * " + div("_c", "_a"))
    .step(_dx="CASE WHEN _a IS NOT NULL THEN coalesce(100 * " + div("abs(plus_di - minus_di)", "plus_di + minus_di") + ", 0) END")
    .step(adx_14=ema("_dx", 14, "mean", 14, True))
    .out("plus_di minus_di adx_14"),
)
def q_adx(spark, sf):
    return finish(settle(scan.adx(ev(spark, sf, 2, scans=True))), "plus_di", "minus_di", "adx_14")


@query("long_span_averages", Sql(SUPPLY).number().step(ema_400=ema("close", 400), wema_1000=ema("close", 1000, "weighted")).out("ema_400 wema_1000"))
def q_long_spans(spark, sf):
    d = scan.scan(sup(spark, sf, 0), [scan.Ema("ema_400", "close", 400), scan.Ema("wema_1000", "close", 1000, "weighted")])
    return finish(settle(d), "ema_400", "wema_1000")
