"""Queries of input adapters, of the functions in SQL, and of rows by number."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import adapters as A
from ..functions.sql import registered
from ..operators.knn import neighbours
from ..shared import shared_path
from ..sources.store import RowStore
from .neighbours import POSITION, near
from .registry import query, table
from .views import FP, RANGES, fingerprints, halves, normalised, ranges, rounded

UNITS = f"{FP}, u AS (SELECT sample_id, unit AS a, len(unit) AS n FROM fp)"


def _between(a: str, n: str, k: str, size: int) -> str:
    """SQL for element ``k`` of ``size`` among the ``n`` elements of a list."""
    at = f"greatest(0.0, ({k} + 0.5) * {n} / {size}.0 - 0.5)"
    low = f"least(floor({at}), {n} - 1)::INT"
    return f"({a}[{low} + 1] * (1 - ({at} - {low})) + {a}[least({low} + 1, {n} - 1)::INT + 1] * ({at} - {low}))"


@query("convolved", f"WITH {UNITS}, p AS (SELECT sample_id, list_concat([0.0, 0.0], a, [0.0, 0.0]) AS p FROM u) SELECT sample_id, list_transform(range(0, (len(p) - 5) // 2 + 1), lambda i: round(0.25 * p[2 * i + 1] - 0.5 * p[2 * i + 3] + 0.75 * p[2 * i + 5] + 0.1, 6) + 0.0) AS v FROM p")
def _(spark, sf_dir):
    """A strided and dilated convolution of each fingerprint."""
    return rounded(normalised(spark, sf_dir).select("sample_id", A.convolved(F.col("features"), [0.25, -0.5, 0.75], stride=2, padding=2, dilation=2, bias=0.1).alias("v")))


@query("tiled", f"WITH {UNITS}, t AS (SELECT sample_id, list_transform(range(0, 40), lambda j: round({_between('a', 'n', 'j', 40)}, 6) + 0.0) AS r FROM u) SELECT sample_id, unnest([0, 1, 2])::INT AS at, r AS v FROM t")
def _(spark, sf_dir):
    """Each fingerprint stretched to 40 and repeated in three rows."""
    rows = normalised(spark, sf_dir).select("sample_id", F.posexplode(A.tiled(F.col("features"), 3, 40)).alias("at", "v"))
    return rounded(rows)


@query("folded", f"""WITH {UNITS}, s AS (SELECT *, floor(sqrt(n))::INT AS h, ceil(n / floor(sqrt(n)))::INT AS w FROM u), f AS (SELECT *, list_concat(a, list_transform(range(0, h * w - n), lambda z: 0.0)) AS p FROM s),
m AS (SELECT *, list_transform(range(0, h), lambda k: p[k * w + 1:k * w + w]) AS m FROM f),
y AS (SELECT *, unnest(range(0, 6))::INT AS line FROM m), z AS (SELECT *, greatest(0.0, (line + 0.5) * h / 6.0 - 0.5) AS pos FROM y), l AS (SELECT *, least(floor(pos), h - 1)::INT AS lo FROM z),
mixed AS (SELECT sample_id, line, w, list_transform(range(1, w + 1), lambda c: m[lo + 1][c] * (1 - (pos - lo)) + m[least(lo + 1, h - 1) + 1][c] * (pos - lo)) AS r FROM l)
SELECT sample_id, line, list_transform(range(0, 5), lambda j: round({_between('r', 'w', 'j', 5)}, 6) + 0.0) AS v FROM mixed""")
def _(spark, sf_dir):
    """Each fingerprint laid in a square and resized to six rows of five."""
    return rounded(normalised(spark, sf_dir).select("sample_id", F.posexplode(A.folded(F.col("features"), 6, 5)).alias("line", "v")))


@query("sql_trilaterate", f"WITH {RANGES} SELECT DISTINCT sample_id, round(tx, 3) + 0.0 AS px, round(ty, 3) + 0.0 AS py, round(tz, 3) + 0.0 AS pz FROM ranges")
def _(spark, sf_dir):
    """Positions from distances by the table function, called in SQL."""
    registered(spark)
    ranges(spark, sf_dir).select("sample_id", "anchor_id", "x", "y", "z", "distance").createOrReplaceTempView("beaconry_ranges")
    return rounded(spark.sql("SELECT * FROM trilaterate(TABLE(beaconry_ranges) PARTITION BY sample_id)"), 3)


@query("sql_locate", f"{near()}, p AS ({POSITION}) SELECT query_id, pred_x, pred_y, position_uncertainty FROM p")
def _(spark, sf_dir):
    """Positions from neighbours by the table function, called in SQL."""
    registered(spark)
    train, test = halves(spark, sf_dir)
    places = train.select(F.col("sample_id").alias("reference_id"), "x", "y")
    neighbours(test, train, 5).join(places, "reference_id").createOrReplaceTempView("beaconry_near")
    return rounded(spark.sql("SELECT * FROM locate_by(TABLE(SELECT query_id, distance, x, y FROM beaconry_near) PARTITION BY query_id)"))


@query("sql_functions", f"WITH {FP} SELECT sample_id, len(list_filter(features, lambda e: e <> 100))::INT AS n, list_transform(unit, lambda e: round(e, 6) + 0.0) AS unit, round(sqrt((x - 5) ^ 2 + (y - 7) ^ 2), 6) AS away FROM fp")
def _(spark, sf_dir):
    """Scalar functions, called in SQL."""
    registered(spark)
    fingerprints(spark, sf_dir).createOrReplaceTempView("beaconry_fingerprints")
    return rounded(spark.sql("SELECT sample_id, detected(features) AS n, wifi_unit(features) AS unit, distance_2d(x, y, 5D, 7D) AS away FROM beaconry_fingerprints"))


@query("rows_by_number", "SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS row, o_orderkey, o_totalprice FROM orders QUALIFY row % 3 = 0 OR row < 100")
def _(spark, sf_dir):
    """Orders numbered by price in a row store: every third one, and the first hundred."""
    store = RowStore.write(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), shared_path(spark, "store"), order=["o_totalprice", "o_orderkey"], size=4000)
    return store[::3].unionByName(store[:100].where("row % 3 <> 0")).select("row", "o_orderkey", "o_totalprice")


@query("network")
def _(spark, sf_dir):
    """Positions and floors by a trained network; trained weights have no SQL."""
    from ..operators.network import NetworkLocalizer

    train, test = halves(spark, sf_dir)
    return rounded(NetworkLocalizer((32,), epochs=6, batch=4096).fit(train).predict(test))
