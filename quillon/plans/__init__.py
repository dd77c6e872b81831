"""Registered queries; importing this package registers all of them."""

from . import advantages, contrasts, conversions, judgements, linting, measures, selections, shapes, storage, strings, texts  # noqa: F401
from .registry import ORACLES, PLANS  # noqa: F401
