"""Binary search over a small constant array, as a JVM-side column expression."""

from __future__ import annotations

import base64
import json
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def constant_array(values: list, element: T.DataType) -> Column:
    """A list the driver knows, folded by the optimizer into one literal of the given type."""
    text = json.dumps(values, default=_as_text)
    return F.from_json(F.lit(text), T.ArrayType(element))


def _as_text(value: Decimal | bytes | bytearray) -> str:
    """How the JSON reader takes decimals and bytes."""
    return format(value, "f") if isinstance(value, Decimal) else base64.b64encode(bytes(value)).decode()


def count_not_above(points: Column, size: int, key: Column) -> Column:
    """How many entries of the ascending array ``points`` are ``<= key``.

    Halving steps over the array: log2(size) comparisons per row.
    """
    if size == 0:
        return F.lit(0)
    steps = [1 << bit for bit in reversed(range(size.bit_length()))]

    def step_up(found: Column, step: Column) -> Column:
        probe = found + step
        inside = F.get(points, probe - 1) <= key
        return F.when(inside, probe).otherwise(found)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), step_up)
