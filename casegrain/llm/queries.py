"""Importing the operator modules fills the registry."""

from casegrain.llm.common import ORACLES, QUERIES  # noqa: F401
from casegrain.llm import bagminhash, chat, collocations, extract, language, manifest, mixing, packing, phrases, scoring, secrets, topk, toxicity  # noqa: F401
