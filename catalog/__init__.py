"""Registered queries over the driver tables, each with its SQL counterpart where SQL can say it."""

from catalog.base import ORACLE, QUERIES  # noqa: F401
from catalog import features, model, profiles, sources, specs, timestamps, windows  # noqa: F401, E402
