"""A convolutional predictor of day fields, trained for each dekad by distributed gradient descent.

A day's field and its reference, each divided by its largest value, missing cells as zeros, are the sample. The days of a
dekad in one year are one row (`day_fields`), at most eleven fields. In a training step each task adds up the gradients of
the rows that it holds, for all dekads at once; the sums of the years of a dekad are added in the order of years, so that a
seed gives the same weights again; one gradient a dekad, whose size depends on the network alone, comes to the driver,
where Adam moves the weights, and these go out with the next step. The last years are held out. A dekad whose held-out
error hasn't fallen for `patience` epochs is done and keeps its best weights.

The network has 3 x 3 convolutions with rectified outputs, dropout after them while training, and a linear sum of the last
channels, so the number of weights doesn't grow with the grid.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEKAD = ("month", "dekad")


@dataclass(frozen=True)
class Network:
    filters: tuple[int, ...] = (32, 64, 64)
    dropout: tuple[float, ...] = (0.2, 0.3, 0.0)

    def shapes(self) -> list[tuple[int, int]]:
        """Weights of each layer, with a row for the constant."""
        ins = (1, *self.filters)
        return [(9 * a + 1, b) for a, b in zip(ins[:-1], ins[1:], strict=True)] + [(self.filters[-1] + 1, 1)]

    def size(self) -> int:
        return sum(a * b for a, b in self.shapes())

    def start(self, rng: np.random.Generator) -> np.ndarray:
        parts = []
        for a, b in self.shapes():
            w = rng.normal(0, np.sqrt(2 / (a - 1)), (a, b))
            w[-1] = 0
            parts.append(w.ravel())
        return np.concatenate(parts)

    def layers(self, flat: np.ndarray) -> list[np.ndarray]:
        ends = np.cumsum([a * b for a, b in self.shapes()])
        return [part.reshape(shape) for part, shape in zip(np.split(flat, ends[:-1]), self.shapes(), strict=True)]

    def _forward(self, flat: np.ndarray, x: np.ndarray, rng: np.random.Generator | None):
        """The field that the network makes of x, and what each layer has seen. With a generator some outputs are dropped."""
        rows, columns = x.shape
        made, seen, *_ = x.reshape(1, -1), []
        layers = self.layers(flat)
        for k, w in enumerate(layers[:-1]):
            near = _neighbours(made.reshape(-1, rows, columns))
            out = w[:-1].T @ near + w[-1][:, None]
            scale = (out > 0).astype(float)
            drop = self.dropout[k] if k < len(self.dropout) else 0.0
            if rng is not None and drop:
                scale *= (rng.random(out.shape) >= drop) / (1 - drop)
            seen.append((near, scale))
            made = out * scale
        return (layers[-1][:-1].T @ made + layers[-1][-1][:, None]).reshape(rows, columns), seen, made

    def predict(self, flat: np.ndarray, x: np.ndarray) -> np.ndarray:
        return self._forward(flat, x, None)[0]

    def loss(self, flat: np.ndarray, x: np.ndarray, y: np.ndarray) -> float:
        return float(np.mean((self.predict(flat, x) - y) ** 2))

    def gradient(self, flat: np.ndarray, x: np.ndarray, y: np.ndarray, rng: np.random.Generator | None = None) -> tuple[float, np.ndarray]:
        """Mean squared error of one field, and its gradient by all weights."""
        out, seen, last = self._forward(flat, x, rng)
        off = (out - y).reshape(1, -1)
        layers, grads = self.layers(flat), []
        back = 2 * off / off.size
        grads.append(np.concatenate([last @ back.T, back.sum(axis=1, keepdims=True).T]))
        back = layers[-1][:-1] @ back
        for (near, scale), w in zip(reversed(seen), reversed(layers[:-1]), strict=True):
            back = back * scale
            grads.append(np.concatenate([near @ back.T, back.sum(axis=1)[None, :]]))
            back = _give_back(w[:-1] @ back, x.shape)
        return float(np.mean(off**2)), np.concatenate([g.ravel() for g in reversed(grads)])


def _neighbours(channels: np.ndarray) -> np.ndarray:
    """(9 x channels, cells): each channel moved by one cell in all directions, zeros beyond the border."""
    n, rows, columns = channels.shape
    wide = np.pad(channels, ((0, 0), (1, 1), (1, 1)))
    return np.concatenate([wide[:, a : a + rows, b : b + columns].reshape(n, -1) for a in range(3) for b in range(3)])


def _give_back(near: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """The reverse of `_neighbours`: what each cell gets back from its copies."""
    rows, columns = shape
    parts = near.reshape(9, -1, rows, columns)
    wide = np.zeros((parts.shape[1], rows + 2, columns + 2))
    for k in range(9):
        wide[:, k // 3 : k // 3 + rows, k % 3 : k % 3 + columns] += parts[k]
    return wide[:, 1:-1, 1:-1].reshape(parts.shape[1], -1)


def _fields(part: pa.Table, rows: int, columns: int, names: Sequence[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Days of a group in order, the place of each row among them, and the dense fields of the named columns, missing as 0."""
    days, at = np.unique(part["time"].to_numpy(), return_inverse=True)
    i, j = part["lat_i"].to_numpy().astype(int), part["lon_i"].to_numpy().astype(int)
    out = []
    for name in names:
        field = np.zeros((len(days), rows, columns))
        field[at, i, j] = np.nan_to_num(part[name].cast(pa.float64()).fill_null(0.0).to_numpy())
        out.append(field)
    return days, at, out


def _to_one(fields: np.ndarray) -> np.ndarray:
    top = fields.max(axis=(1, 2), keepdims=True)
    return np.divide(fields, top, out=fields.copy(), where=top > 0)


def day_fields(rows: DataFrame, height: int, width: int, keys: Sequence[str] = DEKAD) -> DataFrame:
    """(keys, year, days, x, y): the normalised fields of `value` and `ref` of all days of a dekad in one year."""
    schema = f"{', '.join(f'{k} {rows.schema[k].dataType.simpleString()}' for k in keys)}, year int, days int, x binary, y binary"

    def pack(part: pa.Table) -> pa.Table:
        days, _, (x, y) = _fields(part, height, width, ("value", "ref"))
        one = {k: part[k].slice(0, 1) for k in (*keys, "year")}
        return pa.table(one | {"days": pa.array([len(days)], pa.int32()), "x": [_to_one(x).astype("<f4").tobytes()], "y": [_to_one(y).astype("<f4").tobytes()]})

    table = rows.select(*keys, F.year("time").alias("year"), "time", "lat_i", "lon_i", F.col("value").cast("double").alias("value"), F.col("ref").cast("double").alias("ref"))
    return table.groupBy(*keys, "year").applyInArrow(pack, schema)


def _seeded(*parts) -> np.random.Generator:
    return np.random.default_rng(int.from_bytes(hashlib.sha256(repr(parts).encode()).digest()[:8], "little"))


def _sums(fields: DataFrame, years: Sequence[int], net: Network, weights: dict, shape: tuple[int, int], keys: Sequence[str], seed: tuple | None) -> dict:
    """(days, error, gradient) of each dekad over the given years; without a seed the error only."""
    sent = fields.sparkSession.sparkContext.broadcast(weights)
    kinds = ", ".join(f"{k} {fields.schema[k].dataType.simpleString()}" for k in keys)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                period = tuple(one[c] for c in keys)
                if period not in sent.value:
                    continue
                x, y = (np.frombuffer(one[c], "<f4").astype(float).reshape(-1, *shape) for c in ("x", "y"))
                error, total = 0.0, np.zeros(net.size() if seed else 0)
                rng = _seeded(*seed, *period, one["year"]) if seed else None
                for a, b in zip(x, y, strict=True):
                    if seed:
                        e, g = net.gradient(sent.value[period], a, b, rng)
                        total += g
                    else:
                        e = net.loss(sent.value[period], a, b)
                    error += e
                yield pa.RecordBatch.from_pylist([{c: one[c] for c in (*keys, "year", "days")} | {"error": error, "gradient": total.tobytes()}], schema=made)

    def add(part: pa.Table) -> pa.Table:
        part = part.sort_by("year")
        total = sum((np.frombuffer(x.as_py()) for x in part["gradient"]), np.zeros(net.size() if seed else 0))
        error = sum(x.as_py() for x in part["error"])
        return pa.table({k: part[k].slice(0, 1) for k in keys} | {"days": pa.array([sum(x.as_py() for x in part["days"])], pa.int64()), "error": [error], "gradient": pa.array([total.tobytes()], pa.binary())})

    types = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "smallint": pa.int16()}
    made = pa.schema([(k, types[fields.schema[k].dataType.simpleString()]) for k in keys] + [("year", pa.int32()), ("days", pa.int32()), ("error", pa.float64()), ("gradient", pa.binary())])
    parts = fields.filter(F.col("year").isin(list(years))).mapInArrow(each, f"{kinds}, year int, days int, error double, gradient binary")
    got = parts.groupBy(*keys).applyInArrow(add, f"{kinds}, days bigint, error double, gradient binary").collect()
    sent.destroy()
    return {tuple(r[k] for k in keys): (r["days"], r["error"], np.frombuffer(r["gradient"])) for r in got}


def train(
    fields: DataFrame, height: int, width: int, net: Network = Network(), *, keys: Sequence[str] = DEKAD, epochs: int = 100, batch_years: int = 3, rate: float = 1e-3, held: float = 0.2,
    patience: int = 5, seed: int = 42,
) -> DataFrame:
    """The weights of each dekad: (keys, epochs, error, weights), `error` on the held-out last share of the years.

    `fields` is a table of `day_fields`. A dekad with one year only is held against that year. A dekad whose error isn't
    finite keeps a null error and no weights.
    """
    years = sorted(r["year"] for r in fields.select("year").distinct().collect())
    last = max(1, round(held * len(years))) if len(years) > 1 and held else 0
    seen, unseen = years[: len(years) - last], years[len(years) - last :] or years
    periods = sorted(tuple(r) for r in fields.select(*keys).distinct().collect())
    state = {p: {"w": net.start(_seeded(seed, *p)), "m": 0.0, "v": 0.0, "t": 0, "best": np.inf, "kept": None, "bad": 0, "epochs": 0} for p in periods}
    for epoch in range(epochs):
        active = [p for p in periods if state[p]["bad"] < patience]
        if not active:
            break
        order = _seeded(seed, epoch).permutation(seen).tolist()
        for step in range(0, len(order), batch_years):
            sums = _sums(fields, order[step : step + batch_years], net, {p: state[p]["w"] for p in active}, (height, width), keys, (seed, epoch))
            for p, (days, _, gradient) in sorted(sums.items()):
                s, g = state[p], gradient / days
                s["t"] += 1
                s["m"], s["v"] = 0.9 * s["m"] + 0.1 * g, 0.999 * s["v"] + 0.001 * g * g
                s["w"] = s["w"] - rate * (s["m"] / (1 - 0.9 ** s["t"])) / (np.sqrt(s["v"] / (1 - 0.999 ** s["t"])) + 1e-8)
        errors = _sums(fields, unseen, net, {p: state[p]["w"] for p in active}, (height, width), keys, None)
        for p in active:
            s = state[p]
            days, error, _ = errors.get(p, (0, np.nan, None))
            s["epochs"] = epoch + 1
            if days and error / days < s["best"]:
                s["best"], s["kept"], s["bad"] = error / days, s["w"], 0
            elif days:
                s["bad"] += 1
            else:  # no held-out day: there is nothing to stop by
                s["kept"] = s["w"] if np.isfinite(s["w"]).all() else None
    rows = [(*p, s["epochs"], float(s["best"]) if np.isfinite(s["best"]) else None, s["kept"].tolist() if s["kept"] is not None else None) for p, s in state.items()]
    kinds = ", ".join(f"{k} {fields.schema[k].dataType.simpleString()}" for k in keys)
    return fields.sparkSession.createDataFrame(rows, f"{kinds}, epochs int, error double, weights array<double>")


def apply(rows: DataFrame, models: DataFrame, height: int, width: int, net: Network = Network(), keys: Sequence[str] = DEKAD) -> DataFrame:
    """`rows` (value on time and cells) with `predicted`: the network's field times the day's largest value, at least 0; missing where a dekad has no weights.

    One network a dekad, at most 36, goes out with the tasks.
    """
    found = {tuple(r[k] for k in keys): np.array(r["weights"]) for r in models.filter("weights is not null").select(*keys, "weights").collect()}
    sent = rows.sparkSession.sparkContext.broadcast(found)
    names = [c for c in rows.columns if c != "predicted"]

    def run(part: pa.Table) -> pa.Table:
        flat = sent.value.get(tuple(part[k][0].as_py() for k in keys))
        _, at, (x,) = _fields(part, height, width, ("value",))
        out = np.full(part.num_rows, np.nan)
        if flat is not None:
            top = x.max(axis=(1, 2))
            made = np.stack([np.maximum(net.predict(flat, a) * t, 0) if t > 0 else a for a, t in zip(_to_one(x), top, strict=True)])
            out = made[at, part["lat_i"].to_numpy().astype(int), part["lon_i"].to_numpy().astype(int)]
        return part.drop_columns(["__year"]).append_column("predicted", pa.array(out, pa.float64(), mask=np.isnan(out)))

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names)
    return rows.select(*names).withColumn("__year", F.year("time")).groupBy(*keys, "__year").applyInArrow(run, f"{kinds}, predicted double")
