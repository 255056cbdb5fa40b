"""Neighbour queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..models import with_truth
from ..operators.balls import BallIndex
from ..operators.knn import WKNNLocalizer, neighbours, regress, vote, within
from ..operators.metrics import with_error
from ..operators.sparse import SparseIndex
from .registry import query
from .views import SCANS, SPLIT, halves, heard, rounded

DISTANCES = {
    "euclidean": "sqrt(list_sum(list_transform(list_zip(q.unit, t.unit), lambda p: (p[1] - p[2]) ^ 2)))",
    "manhattan": "list_sum(list_transform(list_zip(q.unit, t.unit), lambda p: abs(p[1] - p[2])))",
    "minkowski": "list_sum(list_transform(list_zip(q.unit, t.unit), lambda p: abs(p[1] - p[2]) ^ 3)) ^ (1.0 / 3)",
    "cosine": "1 - list_sum(list_transform(list_zip(q.unit, t.unit), lambda p: p[1] * p[2])) / (sqrt(list_sum(list_transform(q.unit, lambda p: p * p))) * sqrt(list_sum(list_transform(t.unit, lambda p: p * p))))",
}


def near(metric: str = "euclidean", weights: str = "distance", where: str = "true", train: str = "train", k: int = 5) -> str:
    w = "1.0" if weights == "uniform" else "CASE WHEN min(d) OVER (PARTITION BY q) = 0 THEN (d = 0)::INT::DOUBLE ELSE 1 / d END"
    return f"""WITH {SPLIT}, dist AS (SELECT q.sample_id AS q, t.sample_id AS t, t.x, t.y, t.floor, t.building, {DISTANCES[metric]} AS d FROM test q, {train} t WHERE {where}),
nn AS (SELECT *, {w} AS w FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, t) AS rank FROM dist) WHERE rank <= {k})"""


POSITION = "SELECT q AS query_id, round(sum(w * x) / sum(w), 6) AS pred_x, round(sum(w * y) / sum(w), 6) AS pred_y, round(avg(d), 6) AS position_uncertainty, round(1 - least(avg(d) / 20, 1), 6) AS confidence FROM nn GROUP BY q"


def voted(label: str) -> str:
    return f"""SELECT q AS query_id, {label} AS pred_{label}, round(share, 6) AS {label}_confidence FROM (
  SELECT *, row_number() OVER (PARTITION BY q ORDER BY share DESC, {label}) AS n FROM (
    SELECT q, {label}, sum(w) / sum(sum(w)) OVER (PARTITION BY q) AS share FROM nn GROUP BY q, {label})) WHERE n = 1"""


def _position(spark, sf_dir, weights="distance", **options):
    train, test = halves(spark, sf_dir)
    return rounded(regress(neighbours(test, train, 5, **options), train, weights=weights))


query("knn_regress", f"{near()} {POSITION}")(lambda s, d: _position(s, d))
query("knn_uniform", f"{near(weights='uniform')} {POSITION}")(lambda s, d: _position(s, d, "uniform"))
query("knn_manhattan", f"{near('manhattan')} {POSITION}")(lambda s, d: _position(s, d, metric="manhattan"))
query("knn_minkowski3", f"{near('minkowski')} {POSITION}")(lambda s, d: _position(s, d, metric="minkowski", p=3.0))
query("knn_cosine", f"{near('cosine')} {POSITION}")(lambda s, d: _position(s, d, metric="cosine"))


@query("knn_neighbours", f"{near()} SELECT q AS query_id, t AS reference_id, round(d, 6) AS distance, rank::INT AS rank FROM nn")
def _(spark, sf_dir):
    train, test = halves(spark, sf_dir)
    return rounded(neighbours(test, train, 5))


@query("knn_ball_tree", f"{near('manhattan')} SELECT q AS query_id, t AS reference_id, round(d, 6) AS distance, rank::INT AS rank FROM nn")
def _(spark, sf_dir):
    """The same as meeting all blocks, from an index."""
    train, test = halves(spark, sf_dir)
    return rounded(BallIndex.built(train, metric="manhattan").neighbours(test, 5))


@query("sparse_neighbours", f"""WITH {SCANS}, r AS (SELECT scan, ap, (rssi + 104)::DOUBLE AS w FROM long WHERE rssi > -104), n AS (SELECT scan, sum(w * w) AS s FROM r GROUP BY scan),
dots AS (SELECT a.scan AS q, b.scan AS t, sum(a.w * b.w) AS p FROM r a JOIN r b USING (ap) WHERE a.scan % 20 = 0 GROUP BY 1, 2),
d AS (SELECT a.scan AS q, b.scan AS t, sqrt(a.s + b.s - 2 * coalesce(p, 0)) AS d FROM n a JOIN n b ON a.scan % 20 = 0 LEFT JOIN dots ON q = a.scan AND t = b.scan)
SELECT q AS query_id, t AS reference_id, round(d, 6) AS distance, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, t) AS rank FROM d) WHERE rank <= 5""")
def _(spark, sf_dir):
    """Scans nearest to every twentieth one, among all, from inverted lists of their transmitters; powers above -104 count."""
    rows = heard(spark, sf_dir).withColumn("value", F.greatest(F.col("rssi") + 104, F.lit(0)).cast("double"))
    index = SparseIndex(rows, id_col="scan", key="ap")
    return rounded(index.neighbours(rows.where("scan % 20 = 0"), 5, id_col="scan", key="ap"))


def _vote(spark, sf_dir, label, weights="distance"):
    train, test = halves(spark, sf_dir)
    return rounded(vote(neighbours(test, train, 5), train, label, weights=weights))


query("knn_floor_vote", f"{near()} {voted('floor')}")(lambda s, d: _vote(s, d, "floor"))
query("knn_building_vote", f"{near()} {voted('building')}")(lambda s, d: _vote(s, d, "building"))
query("knn_uniform_vote", f"{near(weights='uniform')} {voted('floor')}")(lambda s, d: _vote(s, d, "floor", "uniform"))


@query("knn_null_labels", f"{near(where='t.sample_id % 3 <> 0')} {voted('floor')}")
def _(spark, sf_dir):
    """A third of the floors is unknown and has no vote."""
    train, test = halves(spark, sf_dir)
    known = train.where("sample_id % 3 <> 0")
    return rounded(vote(neighbours(test, known, 5), known, "floor"))


@query("knn_zero_distance", f"{near(train='ranked')} {POSITION}")
def _(spark, sf_dir):
    """Each query is among the references, so only it counts."""
    train, test = halves(spark, sf_dir)
    both = train.unionByName(test)
    return rounded(regress(neighbours(test, both, 5), both))


@query("wknn_full", f"""{near()}, pos AS ({POSITION}), fl AS ({voted('floor')}), bu AS ({voted('building')})
SELECT query_id, pred_x, pred_y, position_uncertainty, confidence, pred_floor, floor_confidence, pred_building, building_confidence,
       round(sqrt((rx - x) ^ 2 + (ry - y) ^ 2), 4) AS error_2d FROM pos JOIN (SELECT q AS query_id, sum(w * x) / sum(w) AS rx, sum(w * y) / sum(w) AS ry FROM nn GROUP BY q) USING (query_id) JOIN fl USING (query_id) JOIN bu USING (query_id) JOIN test ON sample_id = query_id""")
def _(spark, sf_dir):
    train, test = halves(spark, sf_dir)
    both = with_error(with_truth(WKNNLocalizer(k=5).fit(train).predict(test), test))
    both = both.withColumn("error_2d", F.round("error_2d", 4))
    return rounded(both.select("query_id", "pred_x", "pred_y", "position_uncertainty", "confidence", "pred_floor", "floor_confidence", "pred_building", "building_confidence", "error_2d"))


@query("similarity_join", f"""WITH {SPLIT}, pairs AS (SELECT a.sample_id AS query_id, b.sample_id AS reference_id, list_distance(a.unit, b.unit) AS d FROM test a, train b)
SELECT query_id, reference_id, round(d, 6) AS distance FROM pairs WHERE d < 0.9""")
def _(spark, sf_dir):
    """All pairs of similar fingerprints."""
    train, test = halves(spark, sf_dir)
    return rounded(within(test, train, 0.9))


@query("learned_heads")
def _(spark, sf_dir):
    """Positions and floors by Spark's own learners; trained weights have no SQL."""
    from ..operators.heads import learned

    train, test = halves(spark, sf_dir)
    return learned(train, test).select("sample_id", "pred_x", "pred_y", "pred_floor")
