"""All registered queries of the library and their SQL."""

from marlstone import queries, queries_fits, queries_rows  # noqa: F401  they register on import

QUERIES, ORACLES = queries.QUERIES, queries.ORACLES
