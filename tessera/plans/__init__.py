"""The queries of the library, by name."""

from tessera.plans import modelling, quality, series, serving, streams, tables  # noqa: F401
from tessera.plans.catalog import QUERIES, SQL  # noqa: F401
