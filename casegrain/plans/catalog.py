"""Importing the plan modules fills the registry."""

from casegrain.plans.registry import ORACLES, QUERIES  # noqa: F401
from casegrain.plans import changes, entities, files, relational, textindex, values  # noqa: F401
