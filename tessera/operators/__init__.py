"""One query for each relational operator, with the SQL that it is compared with."""

from . import aggregates, expressions, joins, ordering, predicates, scans, subqueries
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "aggregates", "expressions", "joins", "ordering", "predicates", "scans", "subqueries"]
