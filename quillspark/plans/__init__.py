"""Named queries over the driver tables, with the SQL that checks them."""

from quillspark.plans import estimation, firms, market, more, study  # noqa: F401
from quillspark.plans.registry import ORACLES, QUERIES, Query


def all_queries() -> dict[str, Query]:
    return QUERIES


def all_oracles() -> dict[str, str]:
    return ORACLES
