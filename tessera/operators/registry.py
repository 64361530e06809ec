"""Indicator registry and the ``NAME_args_shift`` naming rule."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import windows as W


@dataclass(frozen=True)
class Indicator:
    """``build(bars, *args)`` appends the output columns."""

    name: str
    outputs: tuple[str, ...]
    defaults: tuple
    build: Callable[..., DataFrame]


INDICATORS: dict[str, Indicator] = {}
BY_OUTPUT: dict[str, Indicator] = {}


def indicator(name: str, outputs: str, *defaults):
    """Register an indicator under its name and its output names."""

    def wrap(build):
        entry = Indicator(name, tuple(outputs.split()), defaults, build)
        INDICATORS[name] = entry
        for output in entry.outputs:
            BY_OUTPUT.setdefault(output, entry)
        return build

    return wrap


def parse(factor_name: str) -> tuple[str, list[int], int]:
    """Split ``NAME[_arg...]_shift``; a bare name has shift 0."""
    parts = factor_name.split("_")
    if len(parts) == 1:
        return parts[0], [], 0
    return parts[0], [int(p) for p in parts[1:-1]], int(parts[-1])


def factor(bars: DataFrame, factor_name: str) -> DataFrame:
    """Append one factor under its full name, lagged by the shift in the name."""
    import tessera.operators.indicators  # noqa: F401  fills the registry

    output, args, shift = parse(factor_name)
    entry = BY_OUTPUT[output]
    args = [*args, *entry.defaults[len(args) :]]
    out = entry.build(bars, *args)
    value = F.col(output)
    if shift:
        value = W.delay(value, shift)
    return out.select(*bars.columns, value.alias(factor_name))
