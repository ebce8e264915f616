"""All registered queries (importing the modules fills the registry)."""

from zipledger.plans import scan_queries  # noqa: F401
from zipledger.plans.registry import REGISTRY

__all__ = ["REGISTRY"]

from zipledger.plans import extract_queries  # noqa: F401,E402
from zipledger.plans import quality_queries  # noqa: F401,E402
