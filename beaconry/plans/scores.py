"""Queries over position errors, accuracies and published results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..models import prediction_rows
from ..operators import leaderboard as B
from ..operators import metrics as M
from .registry import query, table
from .views import rounded

#: Predictions and truths made of orders: floors and buildings that are sometimes unknown.
PAIRS = """pairs AS (SELECT o_orderkey AS id, (o_orderkey % 97)::DOUBLE AS gt_x, (o_orderkey % 53)::DOUBLE AS gt_y, (o_orderkey % 97 + o_totalprice % 13)::DOUBLE AS pred_x, (o_orderkey % 53 - o_totalprice % 7)::DOUBLE AS pred_y,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderkey % 5 END AS gt_floor, CASE WHEN o_orderkey % 22 = 0 THEN NULL ELSE o_custkey % 5 END AS pred_floor,
  (o_orderkey % 3)::VARCHAR AS gt_building, (o_custkey % 3)::VARCHAR AS pred_building FROM orders),
e AS (SELECT *, sqrt((pred_x - gt_x) ^ 2 + (pred_y - gt_y) ^ 2) AS err, (pred_floor IS NOT DISTINCT FROM gt_floor) AS fl, (pred_building IS NOT DISTINCT FROM gt_building) AS bu FROM pairs)"""


def pairs(spark, sf_dir):
    o, k, c, p = table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice")
    return o.select(
        k.alias("id"), (k % 97).cast("double").alias("gt_x"), (k % 53).cast("double").alias("gt_y"), (k % 97 + p % 13).alias("pred_x"), (k % 53 - p % 7).alias("pred_y"),
        F.when(k % 11 != 0, k % 5).alias("gt_floor"), F.when(k % 22 != 0, c % 5).alias("pred_floor"), (k % 3).cast("string").alias("gt_building"), (c % 3).cast("string").alias("pred_building"),
    )


def errors(spark, sf_dir):
    return M.with_error(pairs(spark, sf_dir))


@query("err_metrics", f"WITH {PAIRS} SELECT round(avg(err), 6) AS mean_position_error, round(max(err), 6) AS max_position_error, round(sqrt(avg(err * err)), 6) AS rms_position_error FROM e")
def _(spark, sf_dir):
    return rounded(M.evaluated(pairs(spark, sf_dir), ("mean_position_error", "max_position_error", "rms_position_error")))


@query("err_percentiles", f"WITH {PAIRS} SELECT round(quantile_cont(err, 0.5), 6) AS median_position_error, round(quantile_cont(err, 0.75), 6) AS p75, round(quantile_cont(err, 0.9), 6) AS p90, round(quantile_cont(err, 0.95), 6) AS p95 FROM e")
def _(spark, sf_dir):
    return rounded(M.percentiles(errors(spark, sf_dir), {"median_position_error": 50, "p75": 75, "p90": 90, "p95": 95}))


@query("acc_metrics", f"WITH {PAIRS} SELECT round(100 * avg(fl::INT), 6) AS floor_accuracy, round(100 * avg(bu::INT), 6) AS building_accuracy, round(100 * avg((fl AND bu)::INT), 6) AS floor_building_accuracy FROM e")
def _(spark, sf_dir):
    return rounded(M.evaluated(pairs(spark, sf_dir), ("floor_accuracy", "building_accuracy", "floor_building_accuracy")))


@query("evaluator_default", f"WITH {PAIRS} SELECT round(avg(err), 6) AS mean_position_error, round(quantile_cont(err, 0.5), 6) AS median_position_error, round(quantile_cont(err, 0.75), 6) AS percentile_error, round(sqrt(avg(err * err)), 6) AS rms_position_error, round(100 * avg(fl::INT), 6) AS floor_accuracy, round(100 * avg(bu::INT), 6) AS building_accuracy FROM e")
def _(spark, sf_dir):
    return rounded(M.evaluated(pairs(spark, sf_dir)))


@query("evaluation_results", f"""WITH {PAIRS} SELECT round(avg(err), 6) AS mean_error, round(quantile_cont(err, 0.5), 6) AS median_error, round(stddev_pop(err), 6) AS std_error, round(min(err), 6) AS min_error, round(max(err), 6) AS max_error,
  round(sqrt(avg(err * err)), 6) AS rms_error, round(quantile_cont(err, 0.75), 6) AS p75_error, round(quantile_cont(err, 0.9), 6) AS p90_error, round(quantile_cont(err, 0.95), 6) AS p95_error, round(100 * avg(fl::INT), 6) AS floor_accuracy, round(100 * avg(bu::INT), 6) AS building_accuracy FROM e""")
def _(spark, sf_dir):
    return rounded(M.results(pairs(spark, sf_dir)))


@query("cdf_thresholds", f"WITH {PAIRS} SELECT {', '.join(f'round(100 * avg((err <= {t})::INT), 6) AS within_{t}m' for t in M.LIMITS)} FROM e")
def _(spark, sf_dir):
    return rounded(errors(spark, sf_dir).agg(*M.within()))


@query("cdf_curve", f"WITH {PAIRS}, m AS (SELECT max(err) AS top FROM e) SELECT p::INT AS point, round(p * top / 99, 6) AS value, round((SELECT avg((err <= p * top / 99)::INT) FROM e), 6) AS fraction FROM m, range(0, 100) AS r(p)")
def _(spark, sf_dir):
    return rounded(M.cdf_curve(errors(spark, sf_dir)))


@query("ecdf", f"WITH {PAIRS} SELECT id, round(err, 6) AS error_2d, round(row_number() OVER (ORDER BY err, id) / count(*) OVER (), 6) AS fraction FROM e")
def _(spark, sf_dir):
    return rounded(M.empirical_cdf(errors(spark, sf_dir), "id").select("id", "error_2d", "fraction"))


@query("err_histogram", f"""WITH {PAIRS}, m AS (SELECT min(err) AS lo, max(err) AS hi FROM e), c AS (SELECT least(floor((err - lo) / ((hi - lo) / 50)), 49)::INT AS b, count(*) AS n FROM e, m GROUP BY 1)
SELECT r.b::INT AS bin, round(lo + r.b * ((hi - lo) / 50), 6) AS low, round(lo + (r.b + 1) * ((hi - lo) / 50), 6) AS high, coalesce(n, 0) AS n FROM m, range(0, 50) AS r(b) LEFT JOIN c ON c.b = r.b""")
def _(spark, sf_dir):
    return rounded(M.histogram(errors(spark, sf_dir)))


@query("predictions_sink", f"WITH {PAIRS} SELECT round(pred_x, 6) AS pred_x, round(pred_y, 6) AS pred_y, pred_floor, pred_building, gt_x, gt_y, gt_floor, gt_building, round(err, 6) AS error_2d, fl AS floor_correct, bu AS building_correct FROM e")
def _(spark, sf_dir):
    return rounded(prediction_rows(pairs(spark, sf_dir)))


#: The published results again, as SQL that reads no Python: dataset, method, mean error, year, source, state of the art, order.
BOARD = """board(dataset, method, mean_error, year, source, is_sota, ord) AS (VALUES
  ('ujindoorloc', 'GBDT + Sample Diff', 2.45, 2021, 'Li et al., A universal Wi-Fi fingerprint localization method, Satellite Navigation, 2021', TRUE, 0),
  ('ujindoorloc', 'XGBoost + Sample Diff', 3.42, 2021, 'Li et al., Satellite Navigation, 2021', FALSE, 1),
  ('ujindoorloc', 'FasterKAN', 3.56, 2024, 'Kolmogorov-Arnold Networks for Indoor Localization, 2024', FALSE, 2),
  ('ujindoorloc', 'LSTM', 4.2, 2019, 'Hoang et al., Recurrent Neural Networks For Accurate RSSI Indoor Localization, IEEE IoT Journal, 2019', FALSE, 3),
  ('ujindoorloc', 'DNN-WKNN Hybrid', 7.82, 2025, 'Fingerprinting Indoor Positioning Based on Improved Sequential Deep Learning, MDPI Algorithms, 2025', FALSE, 4),
  ('ujindoorloc', 'MLNN', 7.5, 2019, 'Hoang et al., IEEE IoT Journal, 2019', FALSE, 5),
  ('ujindoorloc', 'CNN (Lightweight)', 9.5, 2019, 'Comparison of CNN Applications for RSSI-Based Fingerprint Indoor Localization, MDPI Electronics, 2019', FALSE, 6),
  ('ujindoorloc', 'CNNLoc', 11.78, 2019, 'Song et al., CNNLoc: Deep-Learning Based Indoor Localization with WiFi Fingerprinting, IEEE CCNC, 2019', FALSE, 7),
  ('ujindoorloc', 'CCPos (CDAE-CNN)', 12.4, 2020, 'CDAELoc: Convolutional Denoising Autoencoder for Indoor Localization, 2020', FALSE, 8),
  ('ujindoorloc', 'RADAR (KNN)', 8.1, 2019, 'Hoang et al., IEEE IoT Journal, 2019', FALSE, 9),
  ('ujindoorloc', 'KNN (k=1)', 7.9, 2014, 'Torres-Sospedra et al., UJIndoorLoc: A new multi-building database, IPIN 2014', FALSE, 10),
  ('ujindoorloc', 'WKNN (k=3)', 7.3, 2014, 'Torres-Sospedra et al., IPIN 2014', FALSE, 11),
  ('ujindoorloc', 'Hierarchical DNN', 9.29, 2018, 'Kim et al., A Scalable Deep Neural Network Architecture for Multi-Building Indoor Localization, Big Data Analytics, 2018', FALSE, 12),
  ('ujindoorloc', 'Random Forest', 10.8, 2017, 'Ensemble Methods for WiFi Indoor Localization, 2017', FALSE, 13),
  ('sodindoorloc', 'DNN Hierarchical', 6.78, 2018, 'SOD Dataset Paper', TRUE, 0),
  ('sodindoorloc', 'CNN-2D', 7.23, 2020, 'CNN Indoor Loc', FALSE, 1),
  ('sodindoorloc', 'KNN (k=1)', 12.45, 2018, 'Baseline', FALSE, 2),
  ('sodindoorloc', 'WKNN (k=3)', 10.23, 2018, 'Baseline', FALSE, 3),
  ('sodindoorloc', 'WKNN (k=5)', 9.87, 2018, 'Baseline', FALSE, 4),
  ('sodindoorloc', 'Random Forest', 8.92, 2019, 'Ensemble Study', FALSE, 5),
  ('tampere', 'DNN (3-layer)', 3.45, 2017, 'Tampere Dataset Paper', FALSE, 0),
  ('tampere', 'CNN-1D', 2.89, 2020, '1D Conv Study', TRUE, 1),
  ('tampere', 'ResNet-18', 3.12, 2021, 'Transfer Learning Study', FALSE, 2),
  ('tampere', 'KNN (k=1)', 5.21, 2017, 'Baseline', FALSE, 3),
  ('tampere', 'WKNN (k=3)', 4.56, 2017, 'Baseline', FALSE, 4),
  ('tampere', 'WKNN (k=5)', 4.32, 2017, 'Baseline', FALSE, 5),
  ('tampere', 'Random Forest', 4.78, 2019, 'Ensemble Study', FALSE, 6),
  ('tampere', 'Gaussian Process', 3.89, 2018, 'GP Localization', FALSE, 7))"""
SOTA = "sota AS (SELECT dataset, arg_min(method, k) AS sota_method, arg_min(mean_error, k)::DOUBLE AS sota_error FROM (SELECT *, CASE WHEN is_sota THEN ord - 1000.0 ELSE mean_error END AS k FROM board) GROUP BY dataset)"
#: A result of ours for each dataset, from the errors of the orders' view.
OURS = f"{PAIRS}, ours AS (SELECT dataset, round((SELECT avg(err) FROM e), 6) AS mean_error FROM (SELECT DISTINCT dataset FROM board))"


@query("leaderboard_sota", f"""WITH {BOARD}, {SOTA}, {PAIRS} SELECT dataset, sota_method, sota_error, count(*) AS n, sum((err < sota_error)::INT)::BIGINT AS n_better, gt_floor FROM e, sota GROUP BY ALL""")
def _(spark, sf_dir):
    """How many predictions of each floor are nearer than the state of the art's mean."""
    best = B.state_of_the_art(B.published(spark))
    told = errors(spark, sf_dir).select("gt_floor", M.ERROR).crossJoin(F.broadcast(best))  # a row for each dataset
    return told.groupBy("dataset", "sota_method", "sota_error", "gt_floor").agg(F.count("*").alias("n"), F.sum((F.col(M.ERROR) < F.col("sota_error")).cast("int")).alias("n_better"))


@query("leaderboard_rank", f"""WITH {BOARD}, {SOTA}, {OURS}
SELECT o.dataset, o.mean_error, sum((o.mean_error < b.mean_error)::INT)::BIGINT AS beats_count, (1 + sum((b.mean_error < o.mean_error)::INT))::BIGINT AS ranking, count(*) AS num_entries, any_value(sota_method) AS sota_method, any_value(sota_error) AS sota_error,
  round(o.mean_error - any_value(sota_error), 6) AS gap_to_sota, round(100 * (o.mean_error - any_value(sota_error)) / any_value(sota_error), 6) AS gap_to_sota_percent
FROM ours o JOIN board b USING (dataset) JOIN sota USING (dataset) GROUP BY o.dataset, o.mean_error""")
def _(spark, sf_dir):
    mean = errors(spark, sf_dir).agg(F.round(F.avg(M.ERROR), 6).alias("mean_error"))
    board = B.published(spark)
    ours = board.select("dataset").distinct().crossJoin(F.broadcast(mean))  # one row
    return rounded(B.compared(ours, board))


#: Our mean error of each floor.
FLOORS = f"{PAIRS}, floors AS (SELECT gt_floor, round(avg(err), 6) AS ours FROM e GROUP BY gt_floor)"


def floors(spark, sf_dir):
    return errors(spark, sf_dir).groupBy("gt_floor").agg(F.round(F.avg(M.ERROR), 6).alias("ours"))


@query("leaderboard_sorted", f"""WITH {BOARD}, {FLOORS}, placed AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY mean_error, ord) AS place FROM board)
SELECT gt_floor, ours, dataset, (1 + count(*) FILTER (mean_error <= ours))::INT AS place, max(place) FILTER (mean_error <= ours)::INT AS behind FROM floors, placed GROUP BY ALL""")
def _(spark, sf_dir):
    """The place that each floor's mean error has in a dataset's sorted results, and the last place before it."""
    from pyspark.sql import Window as W

    board = B.published(spark).select("dataset", "mean_error", F.row_number().over(W.partitionBy("dataset").orderBy("mean_error", "ord")).alias("n"))
    before = F.when(F.col("mean_error") <= F.col("ours"), F.col("n"))
    both = floors(spark, sf_dir).crossJoin(F.broadcast(board))  # the published results
    return both.groupBy("gt_floor", "ours", "dataset").agg((1 + F.count(before)).cast("int").alias("place"), F.max(before).alias("behind"))


@query("leaderboard_lookup", f"WITH {BOARD}, {FLOORS} SELECT gt_floor, method, year, round(ours - mean_error, 6) AS gap FROM floors, board WHERE dataset = 'ujindoorloc'")
def _(spark, sf_dir):
    """Each floor's mean error beside the results of one dataset, looked up by its alias."""
    both = floors(spark, sf_dir).crossJoin(F.broadcast(B.published(spark, "UJI")))  # the published results
    return rounded(both.select("gt_floor", "method", "year", (F.col("ours") - F.col("mean_error")).alias("gap")))


@query("leaderboard_authors", f"""WITH {BOARD}, {PAIRS}, authors AS (SELECT dataset, lower(trim(string_split(source, ',')[1])) AS author, arg_min(source, ord) AS source, min(mean_error)::DOUBLE AS best FROM board GROUP BY 1, 2)
SELECT dataset, author, source, best, sum((err < best)::INT)::BIGINT AS n_better FROM authors, e GROUP BY ALL""")
def _(spark, sf_dir):
    """How many predictions are nearer than the best mean that an author has published, with the author's first source."""
    board = B.published(spark)
    best = board.withColumn("author", B.author()).groupBy("dataset", "author").agg(F.min("mean_error").alias("best"))
    told = errors(spark, sf_dir).select(M.ERROR).crossJoin(F.broadcast(B.first_by_author(board).join(best, ["dataset", "author"])))  # the published results
    return told.groupBy("dataset", "author", "source", "best").agg(F.sum((F.col(M.ERROR) < F.col("best")).cast("int")).alias("n_better"))
