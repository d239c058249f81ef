"""Systems of linear equations modulo 2 (XOR systems), one per group."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import Unsolvable


def solve(equations: list[tuple[set[int], int]]) -> dict[int, int]:
    """A solution of equations (variables, constant); free variables are 0.

    Constants may be words: each bit is a system of its own over the same variables.
    """
    rows: dict[int, tuple[int, int]] = {}
    for vars_, c in equations:
        m = 0
        for v in vars_:
            m ^= 1 << v
        while m:
            top = m.bit_length() - 1
            if top not in rows:
                rows[top] = (m, c)
                break
            m, c = m ^ rows[top][0], c ^ rows[top][1]
        if not m and c:
            raise Unsolvable("the equations contradict each other")
    out: dict[int, int] = {}
    for top in sorted(rows):
        m, c = rows[top]
        for v in range(top):
            if m >> v & 1:
                c ^= out.get(v, 0)
        out[top] = c
    return out


def equations(df: DataFrame) -> DataFrame:
    """(system, eq, var) with even repetitions cancelled."""
    return df.groupBy("system", "eq", "var").agg((F.count("*") % 2).alias("n")).where("n = 1").drop("n")


def solve_systems(terms: DataFrame, constants: DataFrame) -> DataFrame:
    """(system, var, value) from (system, eq, var) and (system, eq, c); unsolvable ones raise.

    Systems lie one after another in the partitions, so many small ones share a call."""

    def solved(system: int, rows: list[tuple[int, int | None, int]]) -> list[tuple[int, int, int]]:
        eqs: dict[int, tuple[set[int], int]] = {}
        for eq, var, c in rows:
            vars_, _ = eqs.setdefault(eq, (set(), c))
            if var is not None:
                vars_.add(var)
        got = solve(list(eqs.values()))
        return [(system, v, got.get(v, 0)) for v in sorted({v for _, v, _ in rows if v is not None})]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []  # a system may go on in the next batch

        def table(out: list[tuple[int, int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(3)], names=["system", "var", "value"])

        for b in batches:
            out = []
            for system, eq, var, c in zip(*(col.to_pylist() for col in b.columns)):
                if system != at:
                    out += solved(at, held) if held else []
                    at, held = system, []
                held.append((eq, var, c))
            yield table(out)
        if held:
            yield table(solved(at, held))

    rows = constants.join(equations(terms), ["system", "eq"], "left")
    rows = rows.select(*(F.col(c).cast("long").alias(c) for c in ("system", "eq", "var", "c")))
    return rows.repartition("system").sortWithinPartitions("system").mapInArrow(run, "system long, var long, value long")
