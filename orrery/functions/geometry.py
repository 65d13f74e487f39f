"""Space-filling-curve codes, quantisation and coordinate scaling."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MORTON_BITS = 21


def grid_step(value: Column, low: Column, high: Column) -> Column:
    """Position of a coordinate on a grid of 2^21 steps over its range."""
    span = F.greatest(high - low, F.lit(1e-9))
    return F.floor((value - low) / span * F.lit(float(2**MORTON_BITS - 1))).cast("long")


def _spread(value: Column) -> Column:
    """Move bit i of a 21-bit number to bit 3i by doubling the gaps from the top half down."""
    spread = value.bitwiseAND(F.lit(2**MORTON_BITS - 1))
    for shift in (32, 16, 8, 4, 2):
        run = shift // 2
        mask = sum(((1 << run) - 1) << (3 * run * i) for i in range(64)) & (2**63 - 1)
        spread = spread.bitwiseOR(F.shiftleft(spread, shift)).bitwiseAND(F.lit(mask))
    return spread


def morton(x: Column, y: Column, z: Column) -> Column:
    """63-bit Z-order code of three grid positions."""
    return _spread(x).bitwiseOR(F.shiftleft(_spread(y), 1)).bitwiseOR(F.shiftleft(_spread(z), 2))


def quantised(value: Column, low: Column, span: Column, bits: int = 16) -> Column:
    """Coordinate as an integer of ``bits`` bits over one common range."""
    span = F.when(span > 0, span).otherwise(1.0)
    return F.round((value - low) / span * F.lit(float(2**bits - 1))).cast("int")


def centred(value: Column, low: Column, high: Column, span: Column, half_width: float = 0.5) -> Column:
    """Coordinate scaled by one common span to [-half_width, half_width] around the middle of its range."""
    span = F.when(span > 0, span).otherwise(1.0)
    return (value - (low + high) / 2) / span * F.lit(2.0 * half_width)
