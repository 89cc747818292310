"""Weekly supply-plan collaboration analytics as DataFrame-to-DataFrame functions."""

from supplyplan.plans.scope import EVERY, VarianceFilter
from supplyplan.tables import Tables

__all__ = ["EVERY", "Tables", "VarianceFilter"]
