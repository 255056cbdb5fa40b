"""The engine's functions in SQL: scalar ones as SQL expressions, locators as table functions over partitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

#: Names and definitions of the scalar functions, which the optimizer sees through like any expression.
SCALARS = {
    "wifi_unit(a ARRAY<DOUBLE>) RETURNS ARRAY<DOUBLE>": "transform(a, v -> (if(v = 100D, -104D, v) + 104D) / 104D)",
    "detected(a ARRAY<DOUBLE>) RETURNS INT": "size(filter(a, v -> v <> 100D))",
    "distance_2d(ax DOUBLE, ay DOUBLE, bx DOUBLE, by DOUBLE) RETURNS DOUBLE": "sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))",
    "path_loss_distance(rssi DOUBLE, tx_power DOUBLE, exponent DOUBLE) RETURNS DOUBLE": "pow(10D, (tx_power - rssi) / (10D * exponent))",
    "magnitude(x DOUBLE, y DOUBLE, z DOUBLE) RETURNS DOUBLE": "sqrt(x * x + y * y + z * z)",
    "heading(x DOUBLE, y DOUBLE) RETURNS DOUBLE": "atan2(y, x)",
}


class Trilaterate:
    """``sample_id, px, py, pz`` of each partition's rows ``sample_id, anchor_id, x, y, z, distance``: least squares, of least norm.

    A partition is one sample: ``trilaterate(TABLE(ranges) PARTITION BY sample_id)``. Rows as in ``ranging.trilaterated``.
    """

    LEAST = 4

    def __init__(self) -> None:
        self.key, self.rows = None, []

    def eval(self, row: Row) -> Iterator[tuple]:
        cells = [row[c] for c in ("anchor_id", "x", "y", "z", "distance")]
        self.key = row["sample_id"]
        if None not in cells and cells[4] > 0:
            self.rows.append(tuple(cells))
        return iter(())

    def terminate(self) -> Iterator[tuple]:
        if len(self.rows) >= self.LEAST:
            self.rows.sort(key=lambda r: r[0])
            cells = np.array([r[1:] for r in self.rows], float)
            at, far = cells[:, :3], cells[:, 3]
            a = 2 * (at[:-1] - at[-1])
            b = far[-1] ** 2 - far[:-1] ** 2 + (at[:-1] ** 2).sum(axis=1) - (at[-1] ** 2).sum()
            found = np.linalg.lstsq(a, b, rcond=1e-9)[0]
            yield (self.key, *map(float, found))


class Locate:
    """``query_id, pred_x, pred_y, position_uncertainty`` from a query's neighbours ``query_id, distance, x, y``.

    A partition is one query: ``locate_by(TABLE(near) PARTITION BY query_id)``. Weights are inverse distances; neighbours at
    distance 0 count alone.
    """

    def __init__(self) -> None:
        self.key, self.n, self.far = None, 0, 0.0
        self.sums, self.exact = [0.0, 0.0, 0.0], [0.0, 0.0, 0.0]

    def eval(self, row: Row) -> Iterator[tuple]:
        self.key, d = row["query_id"], row["distance"]
        to, w = (self.exact, 1.0) if d == 0 else (self.sums, 1.0 / d)
        for k, v in enumerate((1.0, row["x"], row["y"])):
            to[k] += w * v
        self.n, self.far = self.n + 1, self.far + d
        return iter(())

    def terminate(self) -> Iterator[tuple]:
        if self.n:
            w, x, y = self.exact if self.exact[0] else self.sums
            yield self.key, x / w, y / w, self.far / self.n


def registered(spark: SparkSession) -> list[str]:
    """Make the functions known to ``spark.sql`` of this session; their names."""
    for told, body in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {told} RETURN {body}")
    spark.udtf.register("trilaterate", udtf(Trilaterate, returnType="sample_id bigint, px double, py double, pz double"))
    spark.udtf.register("locate_by", udtf(Locate, returnType="query_id bigint, pred_x double, pred_y double, position_uncertainty double"))
    return [*(t.partition("(")[0] for t in SCALARS), "trilaterate", "locate_by"]
