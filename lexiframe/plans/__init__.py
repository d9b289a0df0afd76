"""Registered query plans (``QUERIES``) and their SQL oracles (``ORACLE_SQL``)."""
from .queries import QUERIES  # noqa: F401
from .oracle import ORACLE_SQL  # noqa: F401
