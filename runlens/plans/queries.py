"""All registered queries that need no corpus operators."""

from runlens.plans import catalogue, directories, multilingual, streams, telemetry, users  # noqa: F401
from runlens.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
