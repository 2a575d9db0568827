"""All registered queries; importing the plan modules fills the registry."""

from alertloom.plans import documents, outputs, places, reads, writes  # noqa: F401
from alertloom.plans.registry import ORACLES, QUERIES  # noqa: F401
