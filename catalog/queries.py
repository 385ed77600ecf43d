"""All registered queries."""

from catalog import behaviour, extra, factors, jobs, panel, runs, storage  # noqa: F401
from catalog.registry import QUERIES, SQL  # noqa: F401
