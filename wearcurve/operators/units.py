"""Trajectories: rows of a unit with an explicit position, and kernels over whole units."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of several units that a kernel takes at once (a longer unit is taken alone).
BLOCK_ROWS = 200_000


def by_unit(unit: str = "unit_id"):
    return Window.partitionBy(unit)


def in_order(unit: str = "unit_id", t: str = "t"):
    return Window.partitionBy(unit).orderBy(t)


def trailing(rows: int, unit: str = "unit_id", t: str = "t"):
    """The current row and those before it, `rows` in all."""
    return in_order(unit, t).rowsBetween(1 - rows, 0)


def trajectory(df: DataFrame, unit: str, order: list[str], **values: Column | str) -> DataFrame:
    """unit_id, t (0, 1, ...), n (rows of the unit) and the values, by a total order."""
    named = [(F.col(v) if isinstance(v, str) else v).alias(k) for k, v in values.items()]
    d = df.select(F.col(unit).alias("unit_id"), *[F.col(o).alias(f"_o{k}") for k, o in enumerate(order)], *named)  # named first: later windows by unit_id find its rows together
    w = Window.partitionBy("unit_id").orderBy(*[f"_o{k}" for k in range(len(order))])
    return d.select("unit_id", (F.row_number().over(w) - 1).cast("long").alias("t"), F.count("*").over(by_unit()).alias("n"), *values)


def first_index(predicate: Column, t: str = "t") -> Column:
    """Aggregate: the first t at which the predicate holds; null if none."""
    return F.min(F.when(predicate, F.col(t)))


def per_unit(df: DataFrame, columns: list[str], kernel: Callable[[dict[str, np.ndarray], np.ndarray], dict[str, np.ndarray]], schema: str, constant: tuple[str, ...] = (), keep: tuple[str, ...] = ()) -> DataFrame:
    """Runs a vectorised kernel over whole units.

    df has unit_id, t and the columns. The kernel gets units x time arrays (constant ones: one value a unit) and the lengths,
    and returns arrays of the same shape. Columns in keep go through beside the results, so that no join has to bring them back.

    The row number makes Spark deal rows by unit_id and order them by t only where they aren't yet: a trajectory isn't shuffled again.
    Units are taken in blocks of similar memory, so a task holds BLOCK_ROWS rows, or one unit.
    """
    kinds = T._parse_datatype_string(schema)
    types = {"double": pa.float64(), "bigint": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
    names = ["unit_id", "t", *keep, *[f.name for f in kinds]]
    d = df.select(F.col("unit_id").cast("long").alias("unit_id"), F.col("t").cast("long").alias("t"), *dict.fromkeys([*columns, *keep]), F.row_number().over(Window.partitionBy("unit_id").orderBy("t")).alias("_k"))
    result = T.StructType([T.StructField("unit_id", T.LongType()), T.StructField("t", T.LongType()), *[df.schema[k] for k in keep], *kinds])

    def block(t: pa.Table) -> pa.RecordBatch:
        unit = t.column("unit_id").to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
        n = np.diff(np.append(starts, len(unit)))
        given = {c: t.column(c).to_numpy().astype(float) for c in columns}
        flat: dict[str, np.ndarray] = {}
        order, i = np.argsort(n, kind="stable"), 0
        while i < len(order):  # units of similar length, so that padding stays small
            j = i + 1
            while j < len(order) and n[order[j]] <= max(2 * n[order[i]], 64):
                j += 1
            part = order[i:j]
            m = n[part]
            row, step = np.repeat(np.arange(len(part)), m), np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            at = np.repeat(starts[part], m) + step
            padded = {}
            for c, v in given.items():
                if c in constant:
                    padded[c] = v[starts[part]]
                else:
                    padded[c] = np.full((len(part), m.max()), np.nan)
                    padded[c][row, step] = v[at]
            for k, v in kernel(padded, m).items():
                flat.setdefault(k, np.empty(len(unit), v.dtype))[at] = v[row, step]
            i = j
        cols = [t.column(c).combine_chunks() for c in ("unit_id", "t", *keep)]
        for f in kinds:
            v, kind = flat[f.name], types[f.dataType.simpleString()]
            cols.append(pa.array(v, kind, mask=np.isnan(v)) if v.dtype.kind == "f" else pa.array(v.tolist() if v.dtype.kind in "OU" else v, kind))
        return pa.RecordBatch.from_arrays(cols, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            last = batch.column(0)[-1].as_py()
            if rows >= BLOCK_ROWS and last != held[0].column(0)[0].as_py():  # a unit that fills all of it goes on growing, untouched
                t = pa.Table.from_batches(held)
                cut = int(np.searchsorted(t.column("unit_id").to_numpy() == last, True))
                yield block(t.slice(0, cut))
                held = t.slice(cut).to_batches()
                rows = t.num_rows - cut
        if held:
            yield block(pa.Table.from_batches(held))

    return d.mapInArrow(run, result)
