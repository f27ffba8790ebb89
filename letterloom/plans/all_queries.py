"""All core queries; importing a module of this package registers its queries."""

from letterloom.plans import learning, profile, relations, texts, vectors  # noqa: F401
from letterloom.plans.registry import ORACLES, QUERIES

FLAGSHIP = "metric_macro_f1"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
