"""Column-level rules: every formula is a built-in Spark expression."""

from arrears.functions.rounding import round_half_even  # noqa: F401
from arrears.functions import rules  # noqa: F401
