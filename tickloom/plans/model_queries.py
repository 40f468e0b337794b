"""Registered queries: model data, training, scoring, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import labels, modeldata, models, price, ranking, scan, scores, volatility
from tickloom.operators.panel import number_bars, settle
from tickloom.plans.datasets import finish, supply_bars, table
from tickloom.plans.feature_queries import ev, sup
from tickloom.plans.registry import query
from tickloom.plans.sql import SUPPLY, Sql, chg, flag, lag, lead, roll
from tickloom.session import materialise, work_dir

DOCS = "d AS (SELECT l.doc_id, l.quality AS y_true, d.lang, d.source, d.n_chars, least(1.0, d.n_chars / 5000.0) AS y_prob FROM labels l JOIN documents d USING (doc_id))"
H = "CAST('0x' || substr(md5(concat('42:', doc_id)), 1, 12) AS BIGINT)"


def scored_docs(spark, sf):
    """Labelled documents with a score from their length."""
    d = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars"), "doc_id")
    return d.select("doc_id", F.col("quality").alias("y_true"), "lang", "source", "n_chars", F.least(F.lit(1.0), F.col("n_chars") / 5000.0).alias("y_prob"))


CF = "accuracy precision recall f1"


def _rates(group, pred, frm):
    g = f"{group}, " if group else ""
    by = f"GROUP BY {group}" if group else ""
    return (
        f"SELECT *, (tp + tn) / (tp + fp + fn + tn) AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM ("
        f"SELECT {g}CAST(count_if(y_true = 1 AND {pred}) AS BIGINT) AS tp, CAST(count_if(y_true = 0 AND {pred}) AS BIGINT) AS fp, CAST(count_if(y_true = 1 AND NOT ({pred})) AS BIGINT) AS fn, CAST(count_if(y_true = 0 AND NOT ({pred})) AS BIGINT) AS tn FROM {frm} {by})"
    )


def _docs():
    s = Sql(DOCS)
    s.last = "d"
    return s


TAUS = [round(0.05 * i, 2) for i in range(1, 20)]


@query(
    "threshold_tuning",
    _docs()
    .cte("SELECT d.*, t.threshold FROM d, (VALUES " + ", ".join(f"({t}::DOUBLE)" for t in TAUS) + ") t(threshold)")
    .cte(_rates("threshold", "y_prob > threshold", "{last}"))
    .step(n_signals="tp + fp", is_best="CAST(row_number() OVER (ORDER BY f1 DESC, threshold) = 1 AS INTEGER)")
    .out("threshold " + CF, "tp fp fn tn n_signals is_best", keys=""),
)
def q_tau(spark, sf):
    return finish(scores.threshold_table(scored_docs(spark, sf), TAUS), "threshold", *CF.split(), "tp", "fp", "fn", "tn", "n_signals", "is_best", keys=())


@query(
    "confusion_auc",
    _docs()
    .cte(_rates("source", "y_prob > 0.3", "d"), "c")
    .cte("SELECT *, rank() OVER (PARTITION BY source ORDER BY y_prob) + (count(*) OVER (PARTITION BY source, y_prob) - 1) / 2.0 AS rk FROM d", "k")
    .cte("SELECT source, (sum(CASE WHEN y_true = 1 THEN rk END) - count_if(y_true = 1) * (count_if(y_true = 1) + 1) / 2.0) / nullif(count_if(y_true = 1) * count_if(y_true = 0), 0) AS auc FROM k GROUP BY 1", "a")
    .cte("SELECT c.*, a.auc FROM c JOIN a USING (source)")
    .out(CF + " auc", "tp fp fn tn", keys="source"),
)
def q_confusion(spark, sf):
    d = scored_docs(spark, sf)
    c = scores.confusion(d.withColumn("y_pred", (F.col("y_prob") > 0.3).cast("int")), ["source"])
    return finish(c.join(ranking.auc(d, ["source"], "y_prob", "y_true"), "source"), *CF.split(), "auc", "tp", "fp", "fn", "tn", keys=("source",))


@query(
    "roc_curve",
    _docs()
    .cte("SELECT y_prob AS threshold, count_if(y_true = 1) AS p, count_if(y_true = 0) AS n FROM d GROUP BY 1")
    .step(tpr="sum(p) OVER (ORDER BY threshold DESC) / sum(p) OVER ()", fpr="sum(n) OVER (ORDER BY threshold DESC) / sum(n) OVER ()")
    .out("threshold tpr fpr", keys=""),
)
def q_roc(spark, sf):
    return finish(ranking.roc_curve(scored_docs(spark, sf), [], "y_prob", "y_true"), "threshold", "tpr", "fpr", keys=())


@query(
    "stratified_split",
    _docs()
    .step(h=H)
    .cte("SELECT y_true, quantile_cont(CAST(h AS DOUBLE), 0.8) AS cut FROM {last} GROUP BY 1", "q")
    .cte("SELECT s1.doc_id, s1.y_true, CASE WHEN h <= cut THEN 'train' ELSE 'test' END AS split, CAST(h % 5 AS INTEGER) AS fold FROM s1 JOIN q USING (y_true)")
    .out("", "y_true split fold", keys="doc_id"),
)
def q_split(spark, sf):
    d = modeldata.hash_folds(modeldata.stratified_split(scored_docs(spark, sf), "y_true", ["doc_id"]), ["doc_id"])
    return finish(d, "y_true", "split", "fold", keys=("doc_id",))


_NUM = _docs().step(h=H).step(no="row_number() OVER (PARTITION BY y_true ORDER BY h, doc_id) - 1", n="count(*) OVER (PARTITION BY y_true)").cte("SELECT x.*, (SELECT max(n) FROM {last}) AS big, (SELECT min(n) FROM {last}) AS small FROM {last} x")


def _num():
    s = Sql()
    s.ctes, s.last = list(_NUM.ctes), _NUM.last
    return s


@query("undersample", _num().out("", "y_true", keys="doc_id", tail="WHERE no < small"))
def q_under(spark, sf):
    return finish(modeldata.undersample(scored_docs(spark, sf), "y_true", ["doc_id"]), "y_true", keys=("doc_id",))


@query(
    "oversample_and_weights",
    _num()
    .step(_m="CAST(ceil((big - no) / n) AS BIGINT)", weight="(SELECT count(*) FROM d) / (2.0 * n)")
    .cte("SELECT *, unnest(range(_m)) AS c FROM {last}")
    .step(copy="CAST(c AS INTEGER)", draw="2 * (no + c * n) + y_true")
    .out("weight", '"copy" draw y_true', keys="doc_id"),
)
def q_over(spark, sf):
    d = modeldata.class_weights(scored_docs(spark, sf), "y_true")
    o = modeldata.oversample(d, "y_true", ["doc_id"])
    a = modeldata.alternate(d, "y_true", ["doc_id"]).groupBy("doc_id").agg(F.sort_array(F.collect_list("draw")).alias("_d"))
    o = o.join(a, "doc_id").withColumn("draw", F.element_at("_d", F.col("copy") + 1))
    return finish(o, "weight", "copy", "draw", "y_true", keys=("doc_id",))


@query(
    "temporal_split_folds",
    Sql(SUPPLY)
    .number()
    .step(n="count(*) OVER (PARTITION BY symbol)")
    .step(split="CASE WHEN bar_no < floor(n * (1 - 0.2)) THEN 'train' ELSE 'test' END", _sz="n // 6")
    .step(_st="n - 5 * _sz")
    .step(block="CAST(CASE WHEN bar_no < _st THEN 0 ELSE (bar_no - _st) // _sz + 1 END AS INTEGER)")
    .out("", "split block"),
)
def q_temporal(spark, sf):
    d = modeldata.time_folds(modeldata.temporal_split(number_bars(supply_bars(spark, sf), "1d")))
    return finish(d, "split", "block")


@query(
    "sequence_windows",
    Sql(SUPPLY)
    .step(return_1=chg("close", lag("close")), target=flag(f"{chg(lead('close', 5), 'close')} > 0.01"))
    .step(r="coalesce(return_1, 0)")
    .step(sr="list(r) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)", sv="list(volume) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)")
    .step(steps="len(sr)", first_return="sr[1]", last_volume="sv[-1]", sum_volume="list_sum(sv)")
    .out("first_return last_volume sum_volume", "steps target", tail="WHERE len(sr) = 20"),
)
def q_sequences(spark, sf):
    d = price.one_return(sup(spark, sf, 21, 5)).withColumn("r", F.coalesce("return_1", F.lit(0.0)))
    d = labels.forward_return(d, 5).withColumn("target", F.coalesce((F.col("future_return") > 0.01).cast("int"), F.lit(0)))
    d = settle(modeldata.sequences(d, ["r", "volume"], 20))
    s = F.col("sequence")
    d = d.withColumns({"steps": F.size(s).cast("bigint"), "first_return": s[0][0], "last_volume": F.element_at(s, -1)[1], "sum_volume": F.aggregate(s, F.lit(0.0), lambda a, x: a + x[1])})
    return finish(d, "first_return", "last_volume", "sum_volume", "steps", "target")


@query(
    "drift_monitor",
    _docs().step(period="doc_id % 8").cte(_rates("period", "y_prob > 0.3", "{last}")).step(f1_drop="lag(f1) OVER (ORDER BY period) - f1").step(drifted=flag("f1_drop > 0.1")).out(CF + " f1_drop", "tp fp fn tn drifted", keys="period"),
)
def q_drift(spark, sf):
    d = scored_docs(spark, sf).withColumns({"period": F.col("doc_id") % 8, "y_pred": (F.col("y_prob") > 0.3).cast("int")})
    return finish(scores.drift(d, "period"), *CF.split(), "f1_drop", "tp", "fp", "fn", "tn", "drifted", keys=("period",))


@query(
    "error_analysis",
    _docs()
    .cte("SELECT CASE WHEN y_true = 0 AND y_prob > 0.3 THEN 'false_positive' WHEN y_true = 1 AND NOT y_prob > 0.3 THEN 'false_negative' END AS error, * FROM d")
    .cte("SELECT error, count(*) AS rows, avg(n_chars) AS mean_n_chars, avg(y_prob) AS mean_y_prob FROM {last} WHERE error IS NOT NULL GROUP BY 1")
    .out("mean_n_chars mean_y_prob", "rows", keys="error"),
)
def q_errors(spark, sf):
    d = scored_docs(spark, sf).withColumn("y_pred", (F.col("y_prob") > 0.3).cast("int"))
    return finish(scores.error_means(d, ["n_chars", "y_prob"]), "mean_n_chars", "mean_y_prob", "rows", keys=("error",))


@query(
    "ensemble_in_out_sample",
    _docs()
    .step(m1="y_prob", m2="least(1.0, n_chars / 1000.0)", split="CASE WHEN doc_id % 3 = 0 THEN 'test' ELSE 'train' END")
    .cte("SELECT *, " + ", ".join(f"(SELECT 2 * count_if(y_true = 1 AND {m} > 0.5) / nullif(2.0 * count_if(y_true = 1 AND {m} > 0.5) + count_if((y_true = 1) <> ({m} > 0.5)), 0) FROM s1 WHERE split = 'train') AS f_{m}" for m in ("m1", "m2")) + " FROM {last}")
    .step(p="(f_m1 * m1 + f_m2 * m2) / (f_m1 + f_m2)")
    .cte(_rates("split", "p > 0.5", "{last}"))
    .out(CF, "tp fp fn tn", keys="split"),
)
def q_ensemble(spark, sf):
    d = scored_docs(spark, sf).withColumns({"m1": F.col("y_prob"), "m2": F.least(F.lit(1.0), F.col("n_chars") / 1000.0), "split": F.when(F.col("doc_id") % 3 == 0, "test").otherwise("train")})
    e = scores.ensemble(d, ["m1", "m2"], F.col("split") == "train").withColumn("y_pred", (F.col("ensemble_prob") > 0.5).cast("int"))
    return finish(scores.by_split(e), *CF.split(), "tp", "fp", "fn", "tn", keys=("split",))


@query(
    "experiment_leaderboard",
    _docs()
    .cte(" UNION ALL ".join(f"SELECT d.*, {t}::DOUBLE AS threshold FROM d" for t in TAUS))
    .cte(_rates("source, threshold", "y_prob > threshold", "{last}"))
    .cte("SELECT * FROM {last} ORDER BY f1 DESC, source, threshold LIMIT 10")
    .out("threshold f1 precision recall", keys="source"),
)
def q_board(spark, sf):
    t = scores.threshold_table(scored_docs(spark, sf), TAUS, ["source"]).select("source", "threshold", "f1", "precision", "recall")
    return finish(scores.leaderboard([t], "f1"), "threshold", "f1", "precision", "recall", keys=("source",))


@query(
    "standardised_features",
    Sql(SUPPLY)
    .step(return_1=chg("close", lag("close")), _v=roll("avg", "volume", 10))
    .cte("SELECT *, coalesce(return_1, (SELECT avg(return_1) FROM {last})) AS r, coalesce(_v, (SELECT avg(_v) FROM {last})) AS v FROM {last}")
    .cte("SELECT symbol, ts, (r - avg(r) OVER ()) / stddev_pop(r) OVER () AS return_1, (v - avg(v) OVER ()) / stddev_pop(v) OVER () AS volume_sma_10 FROM {last}")
    .out("return_1 volume_sma_10"),
)
def q_standard(spark, sf):
    d = settle(price.one_return(sup(spark, sf, 10)).withColumn("volume_sma_10", volatility.sma("volume", 10)))
    d = materialise(d.select("symbol", "ts", "return_1", "volume_sma_10"), "features")
    d = modeldata.impute_mean(d, ["return_1", "volume_sma_10"])
    return finish(modeldata.standardise(d, ["return_1", "volume_sma_10"]), "return_1", "volume_sma_10")


# --- Spark ML: no SQL twin --------------------------------------------------

FEATS = ["return_1", "return_5", "volume_ratio_10", "rsi_14", "atr_14", "close_zscore"]


def training_rows(spark, sf):
    """Features and target of the event bars, stored once."""
    d = scan.atr(scan.rsi(ev(spark, sf, 60, 4, scans=True), (14,)), (14,))
    d = price.returns(price.volume_features(d), (1, 5))
    d = d.withColumn("close_zscore", volatility.ratio(F.col("close") - volatility.sma("close", 20), volatility.rstd("close", 20)))
    d = settle(labels.threshold_target(d, 4, 0.01))
    d = modeldata.temporal_split(d.select("symbol", "ts", "bar_no", "last_no", "future_return", "target", *FEATS))
    return materialise(d, "training")


@query("forest_and_boosted_scores")
def q_models(spark, sf):
    d = training_rows(spark, sf)
    train = modeldata.class_weights(d.filter("split = 'train'"), "target")
    a = models.forest(FEATS, weight="weight").fit(train)
    b = models.boosted(FEATS, rounds=5).fit(train)
    s = models.score(b, models.score(a, d, "forest_prob"), "boosted_prob").withColumn("y_true", F.col("target"))
    s = scores.ensemble(s, ["forest_prob", "boosted_prob"], F.col("split") == "train")
    return finish(s, "forest_prob", "boosted_prob", "ensemble_prob", "target", "split")


@query("feature_importance")
def q_importance(spark, sf):
    d = training_rows(spark, sf).filter("split = 'train'")
    a = models.importances(models.forest(FEATS).fit(d), FEATS, "forest")
    b = models.importances(models.boosted(FEATS, rounds=5).fit(d), FEATS, "boosted")
    w = models.select_features(models.weighted_importance([(a, 0.6), (b, 0.4)]))
    c = scores.common_features(a.filter("importance > 0.1"), b.filter("importance > 0.1"))
    return finish(w.join(c, "feature", "left"), "importance", "where", keys=("feature",))


@query("model_grid_search")
def q_grid_search(spark, sf):
    d = modeldata.hash_folds(training_rows(spark, sf).filter("split = 'train'"), ["symbol", "ts"], 3)
    _, t = models.grid_search(d, FEATS, fold="fold", depths=(2, 4), trees=(5, 10), folds=3)
    return finish(t, "auc", keys=("depth", "trees"))


@query("principal_components")
def q_pca(spark, sf):
    return finish(models.principal_components(training_rows(spark, sf), FEATS, 3), "loading", "explained", "cumulative", keys=("component", "feature"))


@query("model_store_round_trip")
def q_store(spark, sf):
    d = training_rows(spark, sf)
    base = work_dir(spark, "models")
    models.save_model(models.forest(FEATS, trees=5).fit(d.filter("split = 'train'")), base, "forest", "20240101", {"auc": 0.5, "f1": 0.5})
    return finish(models.score(models.latest_model(spark, base, "forest"), d), "y_prob", "target")


@query("interpolated_minority")
def q_interpolate(spark, sf):
    d = training_rows(spark, sf).filter("split = 'train'")
    return finish(modeldata.interpolate_minority(d, "target", 0, ["return_1", "rsi_14", "close_zscore"], ["symbol", "ts"]), "return_1", "rsi_14", "close_zscore", "target")
