"""Queries on model frames, signals and backtests."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import action, version_name
from ..operators import models, trading
from .domain import feature_rows, predictions, query

_PARAMS = {"max_iter": 40, "learning_rate": 0.1, "max_depth": 3, "min_samples_leaf": 20, "l2_regularization": 1.0}


def _r(df, *cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


def _frame(spark, sf):
    return trading.model_frame(feature_rows(spark, sf), ("click", "signup", "view"), ("error", "purchase"), 1)


_FB = """fb AS (SELECT *, ln(close) - lag(ln(close)) OVER (PARTITION BY symbol ORDER BY bucket) AS log_return FROM (SELECT gr.symbol, gr.bucket, h.close, h.volume, coalesce(h.n_candles, 0) AS n_candles, h.realized_vol FROM grid gr LEFT JOIN hourly h USING (symbol, bucket)) QUALIFY bucket < max(bucket) OVER (PARTITION BY symbol) OR n_candles >= 2)"""
_MF = f"""WITH {_FB},
ins AS (SELECT bucket, max(CASE WHEN symbol = 'error' THEN log_return END) AS error_ret, max(CASE WHEN symbol = 'purchase' THEN l1 END) AS purchase_ret_lag1, max(CASE WHEN symbol = 'error' THEN realized_vol END) AS error_rv FROM (SELECT *, lag(log_return) OVER (PARTITION BY symbol ORDER BY bucket) AS l1 FROM fb) WHERE symbol IN ('error', 'purchase') GROUP BY 1),
own AS (SELECT *, lag(log_return, 2) OVER w AS ret_lag2, volume / nullif(avg(volume) OVER (PARTITION BY symbol ORDER BY bucket ROWS 23 PRECEDING), 0) AS volume_ratio, ln(lead(close) OVER w / close) AS future_return FROM fb WINDOW w AS (PARTITION BY symbol ORDER BY bucket)),
mf AS (SELECT o.*, CASE WHEN future_return IS NOT NULL THEN (future_return > 0)::INT::DOUBLE END AS label, i.error_ret, i.purchase_ret_lag1, i.error_rv FROM own o LEFT JOIN ins i USING (bucket) WHERE symbol IN ('click', 'signup', 'view'))
"""


@query("model_frame", _MF + "SELECT bucket, symbol AS coin, close, label, round(log_return, 6) AS ret, round(ret_lag2, 6) AS ret_lag2, round(volume_ratio, 6) AS volume_ratio, round(error_ret, 6) AS error_ret, round(purchase_ret_lag1, 6) AS purchase_ret_lag1, round(error_rv, 6) AS error_rv, round(sin(2 * pi() * hour(bucket) / 24), 6) AS hour_sin, (symbol = 'click')::INT::DOUBLE AS coin_click FROM mf", "grid hourly")
def model_frame(spark, sf):
    f = _frame(spark, sf)[0].select("bucket", "coin", "close", "label", "ret", "ret_lag2", "volume_ratio", "error_ret", "purchase_ret_lag1", "error_rv", "hour_sin", "coin_click")
    return _r(f, "ret", "ret_lag2", "volume_ratio", "error_ret", "purchase_ret_lag1", "error_rv", "hour_sin")


@query("training_rows", _MF + "SELECT bucket, symbol AS coin, label FROM mf WHERE bucket <= TIMESTAMP '2024-01-20' - INTERVAL 1 HOUR AND label IS NOT NULL AND close IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY bucket DESC) <= 200", "grid hourly")
def training_rows(spark, sf):
    return trading.training_rows(_frame(spark, sf)[0], F.expr("timestamp_ntz'2024-01-20 00:00:00'"), 3600, 200).select("bucket", "coin", "label")


@query("prob_to_action", "SELECT variant, coin, bucket, prob_up, action FROM preds", "preds")
def prob_to_action(spark, sf):
    return predictions(spark, sf).withColumn("action", action(F.col("prob_up"), 0.52, 0.48)).select("variant", "coin", "bucket", "prob_up", "action")


@query("strategy_returns", "SELECT variant, coin, bucket, position, round(fee, 6) AS fee, trade, round(strategy_return, 6) AS strategy_return FROM traded", "traded")
def strategy_returns(spark, sf):
    t = trading.strategy_returns(predictions(spark, sf), ["variant", "coin"], 10)
    return _r(t.select("variant", "coin", "bucket", "position", "fee", "trade", "strategy_return"), "fee", "strategy_return")


_EQ = "SELECT {k}, min(e / m - 1) AS dd FROM (SELECT *, max(e) OVER (PARTITION BY {k} ORDER BY bucket ROWS UNBOUNDED PRECEDING) AS m FROM (SELECT *, exp(sum(ln(1 + strategy_return)) OVER (PARTITION BY {k} ORDER BY bucket ROWS UNBOUNDED PRECEDING)) AS e FROM {t})) GROUP BY {k}"
_AUC = "SELECT {k}, (sum(r) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2) / nullif(count(*) FILTER (label = 1) * count(*) FILTER (label = 0), 0) AS auc FROM (SELECT *, rank() OVER (PARTITION BY {k} ORDER BY prob_up) + (count(*) OVER (PARTITION BY {k}, prob_up) - 1) / 2 AS r FROM preds) GROUP BY {k}"


@query("max_drawdown", f"SELECT variant, coin, round(dd, 5) AS max_drawdown FROM ({_EQ.format(k='variant, coin', t='traded')})", "traded")
def max_drawdown(spark, sf):
    t = trading.strategy_returns(predictions(spark, sf), ["variant", "coin"], 10)
    return trading.equity(t, ["variant", "coin"], "strategy_return", "d").groupBy("variant", "coin").agg(F.round(F.min("d"), 5).alias("max_drawdown"))


@query("auc", f"SELECT variant, coin, round(auc, 6) AS auc FROM ({_AUC.format(k='variant, coin')})", "preds")
def auc(spark, sf):
    return _r(trading.auc(predictions(spark, sf), ["variant", "coin"], "label", "prob_up"), "auc")


_M = "count(*) AS bars, count(*) FILTER (action = 'BUY') AS buy, count(*) FILTER (action = 'SELL') AS sell, count(*) FILTER (action = 'HOLD') AS hold, round(avg(((prob_up > 0.5) = (label = 1))::INT), 6) AS accuracy, round(greatest(avg(label), 1 - avg(label)), 6) AS baseline_accuracy, round(avg((label = 1)::INT) FILTER (action = 'BUY'), 6) AS buy_hit_rate, round(avg((label = 0)::INT) FILTER (action = 'SELL'), 6) AS sell_hit_rate, count(*) FILTER (trade) AS trades"
_NUM = ("accuracy", "baseline_accuracy", "buy_hit_rate", "sell_hit_rate", "auc", "time_in_market")


@query("backtest_metrics", f"SELECT m.*, round(a.auc, 6) AS auc, round(time_in_market, 6) AS time_in_market FROM (SELECT variant, coin, {_M}, avg(position) AS time_in_market FROM traded GROUP BY 1, 2) m JOIN ({_AUC.format(k='variant, coin')}) a USING (variant, coin)".replace("m.*", "m.* EXCLUDE time_in_market"), "traded preds")
def backtest_metrics(spark, sf):
    m = trading.evaluate(predictions(spark, sf), 10)[1].where(F.col("coin") != trading.PORTFOLIO)
    return _r(m.drop("strategy_return", "buy_hold_return", "max_drawdown", "buy_hold_max_drawdown"), *_NUM)


@query("portfolio_metrics", f"SELECT p.variant, round(p.strategy_return, 4) AS strategy_return, round(p.buy_hold_return, 4) AS buy_hold_return, round(p.time_in_market, 6) AS time_in_market, t.trades FROM (SELECT variant, exp(sum(ln(1 + s))) - 1 AS strategy_return, exp(sum(ln(1 + n))) - 1 AS buy_hold_return, avg(p) AS time_in_market FROM (SELECT variant, bucket, avg(strategy_return) AS s, avg(next_return) AS n, avg(position) AS p FROM traded GROUP BY 1, 2) GROUP BY 1) p JOIN (SELECT variant, count(*) FILTER (trade) AS trades FROM traded GROUP BY 1) t USING (variant)", "traded")
def portfolio_metrics(spark, sf):
    m = trading.evaluate(predictions(spark, sf), 10)[1].where(F.col("coin") == trading.PORTFOLIO)
    return _r(_r(m.select("variant", "strategy_return", "buy_hold_return", "time_in_market", "trades"), "time_in_market"), "strategy_return", "buy_hold_return", digits=4)


@query("variant_pivot", "SELECT coin, round(avg(position) FILTER (variant = 'price+news'), 6) AS \"price+news\", round(avg(position) FILTER (variant = 'price_only'), 6) AS price_only FROM traded GROUP BY 1", "traded")
def variant_pivot(spark, sf):
    m = trading.evaluate(predictions(spark, sf), 10)[1].where(F.col("coin") != trading.PORTFOLIO)
    return trading.by_variant(_r(m, "time_in_market"), "time_in_market")


@query("select_best", "SELECT candidate, strategy_return, trades FROM (SELECT row_number() OVER (ORDER BY coin, variant)::INT AS candidate, round(sum(strategy_return), 2) AS strategy_return, count(*) FILTER (trade) AS trades FROM traded GROUP BY coin, variant) ORDER BY strategy_return DESC NULLS LAST, trades, candidate LIMIT 1", "traded")
def select_best(spark, sf):
    t = trading.strategy_returns(predictions(spark, sf), ["variant", "coin"], 10)
    g = t.groupBy("coin", "variant").agg(F.round(F.sum("strategy_return"), 2).alias("strategy_return"), F.count_if("trade").alias("trades"))
    return trading.best_candidate(g.withColumn("candidate", F.row_number().over(W.orderBy("coin", "variant"))).select("candidate", "strategy_return", "trades"))


def _signals(spark, sf):
    p = predictions(spark, sf).where("variant = 'price+news'")
    return p.select(F.col("coin").alias("symbol"), "bucket", "prob_up", "action", F.when(F.hour("bucket") % 8 == 0, F.lit("replay:x")).otherwise(version_name("4h", 1, F.lit("2024-02-01").cast("timestamp_ntz"))).alias("model_version"))


_SIG = "sig AS (SELECT coin AS symbol, bucket, prob_up, action, CASE WHEN hour(bucket) % 8 = 0 THEN 'replay:x' ELSE 'gbt-4h-h1-20240201T0000' END AS model_version FROM preds WHERE variant = 'price+news')"


@query("replay_todo", f"WITH {_SIG} SELECT symbol, bucket FROM sig s WHERE NOT EXISTS (SELECT 1 FROM sig l WHERE l.symbol = s.symbol AND l.bucket = s.bucket AND l.model_version NOT LIKE 'replay:%')", "preds")
def replay_todo(spark, sf):
    s = _signals(spark, sf)
    return trading.to_replay(s.select("symbol", "bucket"), s.where(~F.col("model_version").startswith("replay:")))


@query("replay_buckets", f"WITH {_SIG} SELECT DISTINCT b.bucket FROM (SELECT DISTINCT bucket FROM sig) b CROSS JOIN (VALUES ('click'), ('view')) t(symbol) WHERE NOT EXISTS (SELECT 1 FROM sig s WHERE s.bucket = b.bucket AND s.symbol = t.symbol AND s.model_version NOT LIKE 'replay:%')", "preds")
def replay_buckets(spark, sf):
    from ..operators.joins import missing_pairs

    s = _signals(spark, sf)
    return missing_pairs(s, "bucket", ["click", "view"], "symbol", s.where(~F.col("model_version").startswith("replay:")))


@query("replay_vs_live", "SELECT count(*) AS n, round(avg((a.action = b.action)::INT), 6) AS agreement, round(avg(abs(a.prob_up - b.prob_up)), 6) AS mean_abs_diff FROM preds a JOIN preds b ON a.coin = b.coin AND a.bucket = b.bucket WHERE a.variant = 'price+news' AND b.variant = 'price_only'", "preds")
def replay_vs_live(spark, sf):
    p = predictions(spark, sf).withColumnRenamed("coin", "symbol")
    return _r(trading.compare_signals(p.where("variant = 'price+news'"), p.where("variant = 'price_only'")), "agreement", "mean_abs_diff")


@query("action_changes", f"WITH {_SIG}, c AS (SELECT *, lag(bucket) OVER (PARTITION BY symbol ORDER BY bucket) AS b FROM sig) SELECT symbol, bucket, prob_up, action, model_version, coalesce(action <> lag(action) OVER (PARTITION BY symbol ORDER BY bucket), true) AS changed, CASE WHEN model_version LIKE 'replay:%' THEN 'replayed' ELSE 'live' END AS source FROM sig UNION ALL SELECT symbol, bucket - INTERVAL 2 HOUR, NULL, NULL, NULL, NULL, NULL FROM c WHERE bucket > b + INTERVAL 3 HOUR", "preds")
def action_changes(spark, sf):
    return trading.chart_history(_signals(spark, sf), 7200)


@query("missing_bar_count", f"WITH {_SIG} SELECT symbol, sum(greatest(round(d) - 1, 0))::BIGINT AS missing FROM (SELECT symbol, coalesce(epoch(bucket - lag(bucket) OVER (PARTITION BY symbol ORDER BY bucket)) / 7200, 0) AS d FROM sig) GROUP BY 1", "preds")
def missing_bar_count(spark, sf):
    return trading.missing_bars(_signals(spark, sf), 7200)


@query("signals_latest", f"WITH {_SIG} SELECT symbol, bucket, prob_up, action, model_version FROM sig QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY bucket DESC) = 1", "preds")
def signals_latest(spark, sf):
    from ..sources.readers import signals_latest as read

    return read(_signals(spark, sf))


@query("signals_history", f"WITH {_SIG} SELECT symbol, bucket, prob_up, action, model_version FROM sig WHERE symbol = 'view' AND bucket >= TIMESTAMP '2024-01-30' - INTERVAL 72 HOUR", "preds")
def signals_history(spark, sf):
    from ..sources.readers import signals_history as read

    return read(_signals(spark, sf), "view", "2024-01-30 00:00:00", 72)


@query("signals_latest_model")
def signals_latest_model(spark, sf):
    f, names = _frame(spark, sf)
    return models.generate_signals(f, names, "1h", 3600, 1, 400, 50, _PARAMS, 0.55, 0.45)


@query("replay_signals")
def replay_signals(spark, sf):
    f, names = _frame(spark, sf)
    times = f.where("bucket >= timestamp_ntz'2024-01-29 00:00:00'").select("bucket").distinct()
    return models.predict_at(f, names, times, 3600, 1, 300, 50, _PARAMS, 0.55, 0.45)


@query("walk_forward")
def walk_forward(spark, sf):
    f, names = _frame(spark, sf)
    return models.walk_forward(f, names, "2024-01-25 00:00:00", "2024-01-30 00:00:00", 3600, 1, 24, 400, _PARAMS, 0.55, 0.45)


@query("walk_forward_metrics")
def walk_forward_metrics(spark, sf):
    return trading.evaluate(walk_forward(spark, sf), 10)[1]
