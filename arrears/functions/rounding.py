"""Half-even rounding on the binary value.

The application rounds with numpy / Python ``round`` (ties to even). Spark's
``round`` is half-up and ``bround`` works on the decimal expansion, so both
disagree on near-ties such as 0.05 x an odd tenth. ``rint(x * 10^n) / 10^n``
is the numpy rule, stays inside codegen, and equals DuckDB ``round_even``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_even(col: Column | str, digits: int) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    if digits == 0:
        return F.rint(c)
    scale = float(10 ** digits)
    return F.rint(c * F.lit(scale)) / F.lit(scale)
