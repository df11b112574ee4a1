"""Table reconciliation on Spark: compare, flatten, merge and profile large tables."""

from .operators.compare import Comparison, compare, compare_nested, split_errors
from .operators.skew import SkewPolicy

__all__ = ["Comparison", "SkewPolicy", "compare", "compare_nested", "split_errors"]
