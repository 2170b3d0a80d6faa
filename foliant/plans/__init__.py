"""All registered queries and their SQL."""

from . import registry  # noqa: I001
from . import audited, catalogue, cleaned, matched, measured, tagged  # noqa: F401

QUERIES, ORACLES = registry.QUERIES, registry.ORACLES
