"""One registry for ``queries()`` and ``oracle_sql()``.

``shape`` lists the result columns of a query. ``name:n`` rounds a double to n
digits on both sides, because sums of doubles depend on their order; the tiny
offset keeps exact halves from rounding differently in the two engines.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.plans import oracle

OFFSET = 3.7e-9
SCALE = {n: 10.0**n for n in range(10)}
Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    shape: str
    build: Build
    sql: str | None

    def columns(self) -> list[tuple[str, int | None]]:
        parts = [token.partition(":") for token in self.shape.split()]
        return [(name, int(digits) if digits else None) for name, _, digits in parts]

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        out = []
        for name, digits in self.columns():
            value = F.col(name)
            # rint on a scaled double stays in generated code; round() would go through BigDecimal.
            out.append(value if digits is None else (F.rint((value.cast("double") + OFFSET) * SCALE[digits]) / SCALE[digits] + 0.0).alias(name))
        return self.build(spark, sf_dir).select(*out)

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        out = []
        for name, digits in self.columns():
            if digits is None:
                out.append(f'"{name}"')
                continue
            shifted = f'(CAST("{name}" AS DOUBLE) + CAST({OFFSET!r} AS DOUBLE))'
            scale = f"CAST({SCALE[digits]!r} AS DOUBLE)"
            out.append(f'round({shifted} * {scale}) / {scale} + 0.0 AS "{name}"')
        return f"{oracle.prelude(self.sql)} SELECT {', '.join(out)} FROM ({self.sql}) AS answer"


REGISTRY: dict[str, Query] = {}


def query(name: str, shape: str, sql: str | None = None) -> Callable[[Build], Build]:
    def register(build: Build) -> Build:
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        text = re.sub(r"\s+", " ", sql).strip() if sql else None
        REGISTRY[name] = Query(name, shape, build, text)
        return build

    return register
