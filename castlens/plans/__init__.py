from castlens.plans.oracle import ORACLE
from castlens.plans.queries import QUERIES
from castlens.plans.tables import TABLES, principals, ratings, table

__all__ = ["ORACLE", "QUERIES", "TABLES", "principals", "ratings", "table"]
