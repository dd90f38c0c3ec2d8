"""All registered queries of the vendor-risk operators and their SQL."""

from vendorlens.plans import report_queries  # noqa: F401  registers its queries
from vendorlens.plans.risk_queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
