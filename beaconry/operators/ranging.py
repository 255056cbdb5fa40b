"""Positions from distances to anchors."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAMES = ("xx", "xy", "xz", "yy", "yz", "zz")


def _solved(m: dict[str, Column], b: list[Column]) -> tuple[Column, list[Column]]:
    """Determinant of a symmetric 3 x 3 matrix and the solution of its system by cofactors."""
    a, c, d, e, f, g = (m[k] for k in NAMES)
    inverse = [[e * g - f * f, d * f - c * g, c * f - d * e], [d * f - c * g, a * g - d * d, c * d - a * f], [c * f - d * e, c * d - a * f, a * e - c * c]]
    det = a * inverse[0][0] + c * inverse[1][0] + d * inverse[2][0]
    return det, [sum((x * y for x, y in zip(row[1:], b[1:], strict=True)), row[0] * b[0]) / det for row in inverse]


def trilaterated(ranges: DataFrame, key: str = "sample_id", *, flipped: bool = False, least: int = 4) -> DataFrame:
    """``key, px, py, pz`` by least squares from rows ``key, anchor_id, x, y, z, distance``.

    Anchors without a position or with a distance not above 0 don't count; fewer than ``least`` give no row. The last
    anchor by id is the reference. Anchors in one plane have no unique solution: those few samples get the one of least
    norm. ``flipped`` negates the result.
    """
    good = ranges.where("x is not null and y is not null and z is not null and distance > 0")
    rows = good.select(key, "anchor_id", *(F.col(c).cast("double").alias(c) for c in ("x", "y", "z", "distance")))
    last = rows.groupBy(key).agg(F.max_by(F.struct("x", "y", "z", "distance"), "anchor_id").alias("r"), F.max("anchor_id").alias("last"), F.count("*").alias("n")).where(F.col("n") >= least)
    both = rows.join(last, key).where("anchor_id <> last")
    a = [2 * (F.col(c) - F.col(f"r.{c}")) for c in "xyz"]
    square = lambda at: sum(((F.col(f"{at}{c}") * F.col(f"{at}{c}")) for c in "yz"), F.col(f"{at}x") * F.col(f"{at}x"))
    b = F.col("r.distance") * F.col("r.distance") - F.col("distance") * F.col("distance") + square("") - square("r.")
    each = both.select(key, *(v.alias(f"a{c}") for c, v in zip("xyz", a, strict=True)), b.alias("b"))
    sums = [F.sum(F.col(f"a{p[0]}") * F.col(f"a{p[1]}")).alias(p) for p in NAMES] + [F.sum(F.col(f"a{c}") * F.col("b")).alias(f"b{c}") for c in "xyz"]
    normal = each.groupBy(key).agg(*sums)
    det, solution = _solved({k: F.col(k) for k in NAMES}, [F.col(f"b{c}") for c in "xyz"])
    size = F.greatest(F.col("xx"), F.col("yy"), F.col("zz"))
    told = normal.withColumn("flat", F.abs(det) <= 1e-9 * size * size * size)
    unique = told.where("not flat").select(key, *(v.alias(f"p{c}") for c, v in zip("xyz", solution, strict=True)))

    def least_norm(rows: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        out = []
        for r in rows.to_dict("records"):
            m = np.array([[r["xx"], r["xy"], r["xz"]], [r["xy"], r["yy"], r["yz"]], [r["xz"], r["yz"], r["zz"]]])
            out.append([r[key], *(np.linalg.pinv(m, rcond=1e-9, hermitian=True) @ [r["bx"], r["by"], r["bz"]])])
        return pd.DataFrame(out, columns=[key, "px", "py", "pz"])

    kind = dict(told.dtypes)[key]
    rest = told.where("flat").mapInPandas(lambda parts: (least_norm(p) for p in parts), f"`{key}` {kind}, px double, py double, pz double")
    sign = -1.0 if flipped else 1.0
    return unique.unionByName(rest).select(key, *((F.col(c) * sign).alias(c) for c in ("px", "py", "pz")))
