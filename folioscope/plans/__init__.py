"""Queries over the driver's tables; importing the package registers all of them."""

from folioscope.plans import boards, catalog, lookups, reading, tables, texts  # noqa: F401
