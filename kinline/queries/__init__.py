"""Named queries over the driver's tables, with the SQL that each is held against."""

from kinline.queries import blocking, evaluation, linkage, scalars
from kinline.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "blocking", "evaluation", "linkage", "scalars"]
