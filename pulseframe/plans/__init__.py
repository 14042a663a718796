"""Runnable queries over the driver tables."""

from pulseframe.plans import chain, deidentify, evaluation, files, learning, rules, signals, sparse, streams, waveforms  # noqa: F401
from pulseframe.plans.registry import ORACLES, QUERIES  # noqa: F401
