"""A neural locator trained by Spark: positions and floors from one network, by synchronous mini-batches.

Training rows are packed once into matrices, dealt into batches, and written to the shared folder. For each step every task
adds up the gradient of its matrices of one batch, the sums are added in a tree, and the driver, which holds the weights
alone, takes an AdamW step. Sums are added in a fixed order, so equal input gives equal weights.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import written
from .knn import _measured, matrix, usable

#: Batches of an epoch at most (above, a batch is a larger share of the rows), rows of a matrix, sums that the driver adds.
BATCHES, ROWS, SUMS = 64, 2048, 64
#: Percent of the rows that are held out to tell when to stop, and floors at most.
HELD_OUT, FLOORS = 10, 4096
HELD = -1
PARAMETERS = "hidden array<int>, epochs int, batch int, rate double, decay double, floor_weight double, patience int, seed long, floors array<int>, scale string"


class Network:
    """Weights of a perceptron with two heads; all arrays in one list: weights and biases by layer, then the heads'."""

    def __init__(self, arrays: list[np.ndarray]) -> None:
        self.arrays = arrays

    @classmethod
    def started(cls, width: int, hidden: tuple[int, ...], floors: int, seed: int) -> Network:
        r, arrays, before = np.random.default_rng(seed), [], width
        for size in hidden:
            arrays += [r.normal(0, math.sqrt(2 / max(1, before)), (before, size)), np.zeros(size)]
            before = size
        for size in (2, floors):
            arrays += [r.normal(0, math.sqrt(1 / max(1, before)), (before, size)), np.zeros(size)]
        return cls(arrays)

    def forward(self, x: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Activations by layer, standardised positions, floor logits."""
        seen = [x]
        for k in range(0, len(self.arrays) - 4, 2):
            seen.append(np.maximum(0, seen[-1] @ self.arrays[k] + self.arrays[k + 1]))
        w, b, v, c = self.arrays[-4:]
        return seen, seen[-1] @ w + b, seen[-1] @ v + c

    def loss(self, x: np.ndarray, at: np.ndarray, floor: np.ndarray, weight: float, *, slopes: bool = True) -> tuple[float, list[np.ndarray]]:
        """Summed loss of rows, and its gradient: squared error of positions, and cross entropy of known floors times ``weight``."""
        seen, place, logits = self.forward(x)
        off = place - at
        total, known = float((off * off).sum()), floor >= 0
        d_logits = np.zeros_like(logits)
        if logits.shape[1] and known.any():
            z = logits[known] - logits[known].max(axis=1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(axis=1, keepdims=True)
            rows = np.arange(len(p))
            total += weight * float(-np.log(np.maximum(p[rows, floor[known]], 1e-300)).sum())
            p[rows, floor[known]] -= 1
            d_logits[known] = weight * p
        if not slopes:
            return total, []
        d_place, grads = 2 * off, []
        heads = [seen[-1].T @ d_place, d_place.sum(axis=0), seen[-1].T @ d_logits, d_logits.sum(axis=0)]
        back = d_place @ self.arrays[-4].T + d_logits @ self.arrays[-2].T
        for k in range(len(self.arrays) - 6, -1, -2):
            back = back * (seen[k // 2 + 1] > 0)
            grads = [seen[k // 2].T @ back, back.sum(axis=0), *grads]
            back = back @ self.arrays[k].T
        return total, grads + heads


def _summed(parts: DataFrame) -> np.ndarray:
    """The sum of the arrays in ``parts (part long, data binary)``, a double array each, in the order of ``part``."""

    def added(rows: pa.Table) -> pa.Table:
        order = np.argsort(rows["part"].to_numpy(), kind="stable").tolist()
        data = rows["data"].to_pylist()
        total = sum(np.frombuffer(data[k]) for k in order)
        return pa.table({"part": [rows["part"][order[0]].as_py()], "data": pa.array([total.tobytes()], pa.binary())})

    tree = parts.groupBy(F.pmod("part", F.lit(SUMS)).alias("_g")).applyInArrow(added, "part long, data binary")
    found = sorted((r["part"], bytes(r["data"])) for r in tree.collect())  # SUMS arrays of the network's size at most
    return sum(np.frombuffer(x) for _, x in found) if found else np.zeros(0)


class NetworkLocalizer:
    """Positions and floors from a trained network.

    ``fit`` takes ``sample_id, features, x, y`` and, where it should be predicted, ``floor``, a whole number. Rows with a
    null or odd feature or without a position take no part; unknown floors cost nothing. ``rate`` rises over the first
    epoch and then falls along a cosine; ``decay`` pulls weights, not biases, to 0. Training ends after ``epochs``, or
    ``patience`` epochs without a better loss of the held-out tenth, and the best weights stay.
    """

    def __init__(self, hidden: tuple[int, ...] = (64, 32), *, epochs: int = 40, batch: int = 512, rate: float = 5e-3, decay: float = 1e-4, floor_weight: float = 1.0, patience: int = 8, seed: int = 42) -> None:
        if epochs < 1 or batch < 1 or patience < 1 or any(h < 1 for h in hidden):
            raise ValueError("epochs, batch, patience and layers are above 0")
        self.hidden, self.epochs, self.batch, self.rate, self.decay = tuple(hidden), epochs, batch, rate, decay
        self.floor_weight, self.patience, self.seed = floor_weight, patience, seed
        self.network: Network | None = None
        self.floors: list[int] = []
        self.scale: dict[str, list[float]] = {}
        #: Mean training loss and held-out loss of each epoch.
        self.history: list[tuple[float, float]] = []

    def fit(self, fingerprints: DataFrame) -> NetworkLocalizer:
        named = "floor" in fingerprints.columns
        floor = F.col("floor").cast("int") if named else F.lit(None).cast("int")
        known = usable(fingerprints.where("x is not null and y is not null and not isnan(x) and not isnan(y)"), "sample_id", "features")
        n, width = _measured(known)
        if not n:
            raise ValueError("no fingerprint can be used")
        labels = fingerprints.select(F.col("sample_id").cast("long").alias("id"), F.col("features").cast("array<double>").alias("v"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), floor.alias("floor"))
        finite = lambda c: c.isNotNull() & (c > float("-inf")) & (c < float("inf"))
        rows = labels.where(F.col("id").isNotNull() & F.forall("v", finite) & finite(F.col("x")) & finite(F.col("y")))
        self.floors = [r[0] for r in rows.select("floor").where("floor is not null").distinct().orderBy("floor").limit(FLOORS + 1).collect()]
        if len(self.floors) > FLOORS:
            raise ValueError(f"more than {FLOORS} floors")
        self._measure(rows, width)
        packs, batches = self._packed(rows, n)
        self._train(packs, batches, width)
        return self

    def _measure(self, rows: DataFrame, width: int) -> None:
        """Means and deviations of the features and of the position, from one pass."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            total = np.zeros((width + 2, 2))
            n = 0
            for b in batches:
                x = np.concatenate([matrix(b.column(0)), np.stack([b.column(1).to_numpy(), b.column(2).to_numpy()], axis=1)], axis=1)
                total += np.stack([x.sum(axis=0), (x * x).sum(axis=0)], axis=1)
                n += len(x)
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([np.append(total.ravel(), n).tobytes()], pa.binary())], names=["part", "data"])

        told = _summed(rows.select("v", "x", "y").mapInArrow(run, "part long, data binary"))
        sums, n = told[:-1].reshape(-1, 2), told[-1]
        mean = sums[:, 0] / n
        spread = np.sqrt(np.maximum(0, sums[:, 1] / n - mean * mean))
        spread[spread < 1e-9] = 1.0
        short = lambda a: [float(f"{x:.10g}") for x in a.tolist()]  # noqa: E731  the order of sums doesn't show
        self.scale = {"mean": short(mean), "spread": short(spread)}

    def _packed(self, rows: DataFrame, n: int) -> tuple[DataFrame, int]:
        """``batch, part, n, x, at, floor``: matrices of at most about ROWS standardised rows; held-out rows are batch HELD."""
        batches = max(1, min(BATCHES, n // self.batch))
        seed, floors = self.seed, {f: k for k, f in enumerate(self.floors)}
        mean, spread = (np.array(self.scale[k]) for k in ("mean", "spread"))
        held = F.pmod(F.xxhash64(F.lit(seed), F.lit("held"), "id"), F.lit(100)) < (HELD_OUT if n > 20 else 0)
        batch = F.when(held, HELD).otherwise(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(batches))).cast("int")
        parts = max(1, -(-n // (batches * ROWS)))
        dealt = rows.withColumn("batch", batch).withColumn("part", F.pmod(F.xxhash64("id", "v", F.lit(seed)), F.lit(parts)))

        def packed(t: pa.Table) -> pa.Table:
            order = np.lexsort((t["x"].to_numpy(), t["id"].to_numpy())).tolist()
            t = t.take(order)
            x = (matrix(t["v"].combine_chunks()) - mean[:-2]) / spread[:-2]
            at = (np.stack([t["x"].to_numpy(), t["y"].to_numpy()], axis=1) - mean[-2:]) / spread[-2:]
            floor = np.array([-1 if f is None else floors[f] for f in t["floor"].to_pylist()], np.int64)
            number = t["batch"][0].as_py()
            told = {"batch": number, "part": (number + 1) * (1 << 32) + t["part"][0].as_py(), "n": len(x), "x": x.tobytes(), "at": at.tobytes(), "floor": floor.tobytes()}
            return pa.Table.from_pylist([told], schema=pa.schema([("batch", pa.int32()), ("part", pa.int64()), ("n", pa.int64()), ("x", pa.binary()), ("at", pa.binary()), ("floor", pa.binary())]))

        made = dealt.groupBy("batch", "part").applyInArrow(packed, "batch int, part long, n long, x binary, at binary, floor binary")
        return written(made.repartition("batch").sortWithinPartitions("batch"), "packs"), batches

    def _told(self, packs: DataFrame, network: Network, *, slopes: bool) -> tuple[float, int, list[np.ndarray]]:
        """Summed loss, rows and gradient over ``packs``."""
        sent, weight = packs.sparkSession.sparkContext.broadcast(network.arrays), self.floor_weight  # the weights

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = Network(sent.value)
            for b in batches:
                for part, n, x, at, floor in zip(*(b.column(c).to_pylist() for c in ("part", "n", "x", "at", "floor")), strict=True):
                    loss, grads = held.loss(np.frombuffer(x).reshape(n, -1), np.frombuffer(at).reshape(n, 2), np.frombuffer(floor, np.int64), weight, slopes=slopes)
                    data = np.concatenate([np.array([loss, n]), *(g.ravel() for g in grads)])
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([data.tobytes()], pa.binary())], names=["part", "data"])

        told = _summed(packs.mapInArrow(run, "part long, data binary"))
        sent.unpersist()
        if not len(told):
            return 0.0, 0, []
        grads, at = [], 2
        for a in network.arrays if slopes else []:
            grads.append(told[at : at + a.size].reshape(a.shape))
            at += a.size
        return float(told[0]), int(told[1]), grads

    def _train(self, packs: DataFrame, batches: int, width: int) -> None:
        network = Network.started(width, self.hidden, len(self.floors), self.seed)
        first, second = ([np.zeros_like(a) for a in network.arrays] for _ in range(2))
        best, kept, since, step, steps = math.inf, network, 0, 0, self.epochs * batches
        self.history = []
        for epoch in range(self.epochs):
            total = rows = 0
            for b in np.random.default_rng((self.seed, epoch)).permutation(batches).tolist():
                loss, n, grads = self._told(packs.where(F.col("batch") == b), network, slopes=True)
                if not n:
                    continue
                step += 1
                rate = self.rate * min(1.0, step / batches) * 0.5 * (1 + math.cos(math.pi * step / steps))
                moved = []
                for a, g, m, v in zip(network.arrays, grads, first, second, strict=True):
                    g = g / n
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    pace = (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
                    moved.append(a - rate * (pace + (self.decay * a if a.ndim == 2 else 0)))
                network = Network(moved)
                total, rows = total + loss, rows + n
            held, n, _ = self._told(packs.where(F.col("batch") == HELD), network, slopes=False)
            told = held / n if n else total / max(1, rows)
            self.history.append((total / max(1, rows), told))
            if told < best - 1e-9:
                best, kept, since = told, network, 0
            elif (since := since + 1) >= self.patience:
                break
        self.network = kept

    def predict(self, queries: DataFrame) -> DataFrame:
        """``query_id, pred_x, pred_y`` and, with floors, ``pred_floor, floor_confidence``: a row for each query, nulls for odd vectors."""
        if self.network is None:
            raise RuntimeError("fit first")
        sent = queries.sparkSession.sparkContext.broadcast((self.network.arrays, self.scale, self.floors))
        width, floors = len(self.scale["mean"]) - 2, bool(self.floors)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            arrays, scale, names = sent.value
            mean, spread = np.array(scale["mean"]), np.array(scale["spread"])
            network = Network(arrays)
            for b in batches:
                good = np.asarray(b.column(1).is_valid())
                x = matrix(b.column(1).drop_null())
                if len(x) and x.shape[1] != width:
                    raise ValueError(f"queries of {x.shape[1]} elements can't be located by a network of {width}")
                _, place, logits = network.forward((x.reshape(len(x), width) - mean[:-2]) / spread[:-2])
                place = place * spread[-2:] + mean[-2:]
                full = lambda values, kind, hole: pa.array(_spread_out(values, good, hole), kind, mask=~good)
                out = [b.column(0), full(place[:, 0], pa.float64(), 0.0), full(place[:, 1], pa.float64(), 0.0)]
                if floors:
                    z = np.exp(logits - logits.max(axis=1, keepdims=True, initial=-np.inf))
                    at = logits.argmax(axis=1) if len(logits) else np.empty(0, np.int64)
                    out += [full(np.array(names)[at], pa.int32(), 0), full(z[np.arange(len(at)), at] / z.sum(axis=1), pa.float64(), 0.0)]
                yield pa.RecordBatch.from_arrays(out, names=["query_id", "pred_x", "pred_y", "pred_floor", "floor_confidence"][: len(out)])

        finite = F.forall("v", lambda c: c.isNotNull() & (c > float("-inf")) & (c < float("inf")))
        asked = queries.select(F.col("sample_id").cast("long").alias("id"), F.col("features").cast("array<double>").alias("v")).select("id", F.when(finite, F.col("v")).alias("v"))
        return asked.mapInArrow(run, "query_id long, pred_x double, pred_y double" + ", pred_floor int, floor_confidence double" * floors)

    def save(self, path: str) -> None:
        """Weights as Parquet, a row for each array; parameters as JSON."""
        spark = SparkSession.getActiveSession()
        rows = [(k, list(a.shape), a.tobytes()) for k, a in enumerate(self.network.arrays)]
        spark.createDataFrame(rows, "k int, shape array<int>, data binary").coalesce(1).write.mode("overwrite").parquet(f"{path}/weights")
        told = (list(self.hidden), self.epochs, self.batch, self.rate, self.decay, self.floor_weight, self.patience, self.seed, self.floors, json.dumps(self.scale))
        spark.createDataFrame([told], PARAMETERS).coalesce(1).write.mode("overwrite").json(f"{path}/parameters")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> NetworkLocalizer:
        told = spark.read.schema(PARAMETERS).json(f"{path}/parameters").first()
        out = cls(tuple(told["hidden"] or ()), **{k: told[k] for k in ("epochs", "batch", "rate", "decay", "floor_weight", "patience", "seed")})
        rows = spark.read.parquet(f"{path}/weights").orderBy("k").collect()  # the weights
        out.network = Network([np.frombuffer(bytes(r["data"])).reshape(r["shape"]) for r in rows])
        out.floors, out.scale = list(told["floors"] or []), json.loads(told["scale"])
        return out


def _spread_out(values: np.ndarray, good: np.ndarray, hole: float) -> np.ndarray:
    """``values`` at the places of ``good``, ``hole`` elsewhere."""
    out = np.full(len(good), hole, values.dtype if len(values) else type(hole))
    out[good] = values
    return out

