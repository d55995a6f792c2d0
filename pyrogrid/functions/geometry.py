"""Kernel size from frame size."""

from pyspark.sql import Column, functions as F


def odd_kernel(height: Column, width: Column, factor) -> Column:
    size = F.floor(F.least(height, width) * (factor if isinstance(factor, Column)
                                             else F.lit(float(factor)))).cast("int")
    return F.greatest(F.lit(3), size.bitwiseOR(F.lit(1)))


def odd_kernel_of(height: int, width: int, factor: float) -> int:
    return max(3, int(min(height, width) * factor) | 1)
