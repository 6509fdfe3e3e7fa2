"""Summaries that can be aggregated, framed and merged.

Both classes build one STRUCT column from Spark's own aggregates, so the same
summary serves a ``groupBy``, a running frame, and the merge of two disjoint
groups of rows. A merge never subtracts, so no digits are lost.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def _over(c: Column, frame: WindowSpec | None) -> Column:
    return c if frame is None else c.over(frame)


@dataclass(frozen=True)
class Moments:
    """Count, means and centred cross products of columns that are NULL together.

    ``pairs`` lists the products wanted; all of them when left out.
    """

    names: tuple[str, ...]
    pairs: tuple[tuple[str, str], ...] = ()

    def __post_init__(self) -> None:
        if not self.pairs:
            every = tuple((a, b) for k, a in enumerate(self.names) for b in self.names[k:])
            object.__setattr__(self, "pairs", every)

    @property
    def columns(self) -> tuple[str, ...]:
        return self.names

    @staticmethod
    def _c(a: str, b: str) -> str:
        return f"c_{a}_{b}"

    def aggregate(self, frame: WindowSpec | None = None, where: Column | None = None) -> Column:
        col = {v: F.col(v) if where is None else F.when(where, F.col(v)) for v in self.names}
        fields = [_over(F.count(col[self.names[0]]), frame).cast("double").alias("n")]
        fields += [
            F.coalesce(_over(F.avg(col[v]), frame), F.lit(0.0)).alias(f"m_{v}") for v in self.names
        ]
        fields += [
            F.coalesce(_over(F.regr_sxy(col[a], col[b]), frame), F.lit(0.0)).alias(self._c(a, b))
            for a, b in self.pairs
        ]
        return F.struct(*fields)

    def merge(self, a: Column, b: Column) -> Column:
        """Pairwise update of Chan, Golub and LeVeque (1979)."""
        n_b = F.coalesce(b["n"], F.lit(0.0))
        n = a["n"] + n_b
        share = F.coalesce(F.try_divide(n_b, n), F.lit(0.0))

        def gap(v: str) -> Column:
            return F.when(n_b > 0, b[f"m_{v}"] - a[f"m_{v}"]).otherwise(F.lit(0.0))

        fields = [n.alias("n")]
        fields += [(a[f"m_{v}"] + gap(v) * share).alias(f"m_{v}") for v in self.names]
        fields += [
            (
                a[self._c(p, q)]
                + F.when(n_b > 0, b[self._c(p, q)]).otherwise(F.lit(0.0))
                + gap(p) * gap(q) * a["n"] * share
            ).alias(self._c(p, q))
            for p, q in self.pairs
        ]
        return F.struct(*fields)

    def without(self, a: Column, b: Column) -> Column:
        """Summary of the rows of ``a`` that are not in its part ``b``."""
        n_b = F.coalesce(b["n"], F.lit(0.0))
        n = a["n"] - n_b

        def mean(v: str) -> Column:
            shift = (a[f"m_{v}"] - b[f"m_{v}"]) * F.try_divide(n_b, n)
            return a[f"m_{v}"] + F.when(n_b > 0, shift).otherwise(F.lit(0.0))

        def product(p: str, q: str) -> Column:
            whole = a[self._c(p, q)]
            between = (b[f"m_{p}"] - mean(p)) * (b[f"m_{q}"] - mean(q)) * n_b * F.try_divide(n, a["n"])
            rest = whole - F.when(n_b > 0, b[self._c(p, q)] + between).otherwise(F.lit(0.0))
            if p == q:  # rounding left over from rows taken out is not variance
                rest = F.when(rest > whole * 1e-13, rest).otherwise(F.lit(0.0))
            return rest.alias(self._c(p, q))

        fields = [n.alias("n")]
        fields += [mean(v).alias(f"m_{v}") for v in self.names]
        fields += [product(p, q) for p, q in self.pairs]
        return F.struct(*fields)

    def running(self, parts: Column, frame: WindowSpec, pivot: Column) -> Column:
        """Merge of the part summaries in ``frame``, one row per part.

        Sums are taken around ``pivot`` (another summary of the same series,
        e.g. its first part) so that a large common mean does not cost digits.
        """
        n = F.coalesce(F.sum(parts["n"]).over(frame), F.lit(0.0))

        def off(v: str) -> Column:
            return parts[f"m_{v}"] - pivot[f"m_{v}"]

        def shift(v: str) -> Column:
            total = F.sum(parts["n"] * off(v)).over(frame)
            return F.coalesce(F.try_divide(total, n), F.lit(0.0))

        fields = [n.alias("n")]
        fields += [(pivot[f"m_{v}"] + shift(v)).alias(f"m_{v}") for v in self.names]
        for p, q in self.pairs:
            total = F.sum(parts[self._c(p, q)] + parts["n"] * off(p) * off(q)).over(frame)
            fields.append(
                (F.coalesce(total, F.lit(0.0)) - n * shift(p) * shift(q)).alias(self._c(p, q))
            )
        return F.struct(*fields)

    def c(self, s: Column, a: str, b: str) -> Column:
        """Centred product; the variance of a constant column is exactly 0."""
        value = s[self._c(a, b) if (a, b) in self.pairs else self._c(b, a)]
        if a != b:
            return value
        rounding = s["n"] * s[f"m_{a}"] * s[f"m_{a}"] * 1e-20
        return F.when(value > rounding, value).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class Extremes:
    """Count, smallest and largest value of one column."""

    name: str

    def aggregate(self, frame: WindowSpec | None = None, where: Column | None = None) -> Column:
        c = F.col(self.name) if where is None else F.when(where, F.col(self.name))
        return F.struct(
            _over(F.count(c), frame).cast("double").alias("n"),
            _over(F.min(c), frame).alias("low"),
            _over(F.max(c), frame).alias("high"),
        )

    def merge(self, a: Column, b: Column) -> Column:
        return F.struct(
            (a["n"] + F.coalesce(b["n"], F.lit(0.0))).alias("n"),
            F.least(a["low"], b["low"]).alias("low"),
            F.greatest(a["high"], b["high"]).alias("high"),
        )

    def running(self, parts: Column, frame: WindowSpec, pivot: Column) -> Column:
        return F.struct(
            F.coalesce(F.sum(parts["n"]).over(frame), F.lit(0.0)).alias("n"),
            F.min(parts["low"]).over(frame).alias("low"),
            F.max(parts["high"]).over(frame).alias("high"),
        )


@dataclass(frozen=True)
class Sums:
    """Count and plain sums of columns."""

    names: tuple[str, ...]

    def aggregate(self, frame: WindowSpec | None = None, where: Column | None = None) -> Column:
        col = {v: F.col(v) if where is None else F.when(where, F.col(v)) for v in self.names}
        fields = [_over(F.count(col[self.names[0]]), frame).cast("double").alias("n")]
        fields += [F.coalesce(_over(F.sum(col[v]), frame), F.lit(0.0)).alias(v) for v in self.names]
        return F.struct(*fields)

    def merge(self, a: Column, b: Column) -> Column:
        return F.struct(
            *[(a[v] + F.coalesce(b[v], F.lit(0.0))).alias(v) for v in ("n", *self.names)]
        )

    def without(self, a: Column, b: Column) -> Column:
        return F.struct(*[(a[v] - F.coalesce(b[v], F.lit(0.0))).alias(v) for v in ("n", *self.names)])

    @property
    def columns(self) -> tuple[str, ...]:
        return self.names

    def running(self, parts: Column, frame: WindowSpec, pivot: Column) -> Column:
        return F.struct(
            *[F.coalesce(F.sum(parts[v]).over(frame), F.lit(0.0)).alias(v) for v in ("n", *self.names)]
        )


@dataclass(frozen=True)
class Bundle:
    """Several summaries taken in one pass over the same frame."""

    parts: tuple[tuple[str, object], ...]

    @property
    def columns(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(c for _, s in self.parts for c in s.columns))

    def _each(self, make) -> Column:
        return F.struct(*[make(name, s).alias(name) for name, s in self.parts])

    def aggregate(self, frame: WindowSpec | None = None, where: Column | None = None) -> Column:
        return self._each(lambda name, s: s.aggregate(frame, where))

    def merge(self, a: Column, b: Column) -> Column:
        return self._each(lambda name, s: s.merge(a[name], b[name]))

    def running(self, parts: Column, frame: WindowSpec, pivot: Column) -> Column:
        return self._each(lambda name, s: s.running(parts[name], frame, pivot[name]))

    def without(self, a: Column, b: Column) -> Column:
        return self._each(lambda name, s: s.without(a[name], b[name]))
