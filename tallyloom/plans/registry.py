"""The registered queries and the SQL they are held against."""

from tallyloom.plans import activity, charts, distributions, feedback, links, matrices, terminology, texts  # noqa: F401
from tallyloom.plans.register import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
