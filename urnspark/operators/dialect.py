"""The few names that differ between Spark SQL and the SQL that checks it."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Dialect:
    spark: bool

    def weekday(self, d: str) -> str:
        """Monday is 0."""
        return f"weekday({d})" if self.spark else f"(isodow({d}) - 1)"

    def days(self, d: str) -> str:
        """Days since 1990."""
        return f"datediff({d}, DATE'1990-01-01')" if self.spark else f"date_diff('day', DATE '1990-01-01', {d})"

    def median(self, x: str) -> str:
        return f"percentile({x}, 0.5e0)" if self.spark else f"quantile_cont({x}, 0.5)"

    def quantiles(self, x: str, n: int) -> str:
        return f"percentile({x}, array({', '.join(f'{i / n}e0' for i in range(n + 1))}))" if self.spark else f"quantile_cont({x}, [{', '.join(str(i / n) for i in range(n + 1))}])"

    def count_if(self, c: str) -> str:
        return f"count_if({c})" if self.spark else f"CAST(count(*) FILTER (WHERE {c}) AS BIGINT)"

    def at(self, a: str, i: str) -> str:
        """The i-th of an array, from 1."""
        return f"element_at({a}, {i})" if self.spark else f"{a}[{i}]"

    def quantile(self, x: str, q: float) -> str:
        return f"percentile({x}, {q}e0)" if self.spark else f"quantile_cont({x}, {q})"

    def series(self, n: int) -> str:
        """A query of x, 0 to n - 1."""
        return f"SELECT CAST(id AS BIGINT) AS x FROM range({n})" if self.spark else f"SELECT unnest(range(0, {n})) AS x"

    def random(self, x: str) -> str:
        """32 bits from the hash of a text."""
        h = f"substring(md5({x}), 1, 8)"
        return f"CAST(conv({h}, 16, 10) AS BIGINT)" if self.spark else f"CAST('0x' || {h} AS BIGINT)"

    def big(self, x: str) -> str:
        return f"CAST({x} AS BIGINT)"


SPARK, CHECK = Dialect(True), Dialect(False)
