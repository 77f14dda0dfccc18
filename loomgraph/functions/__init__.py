"""Column functions that operators and vertex programs share."""

from ..gen.graphs import uniform
from .aggregates import any_of, greatest_by, least_by, sum_at_least

__all__ = ["any_of", "greatest_by", "least_by", "sum_at_least", "uniform"]
