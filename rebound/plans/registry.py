"""Import every query module so the registry is complete."""

from __future__ import annotations

import importlib

from rebound.plans.catalog import REGISTRY

MODULES = [
    "rebound.plans.q_labels",
    "rebound.plans.q_metrics",
    "rebound.plans.q_drift",
    "rebound.plans.q_features",
    "rebound.plans.q_profile",
    "rebound.plans.q_history",
    "rebound.plans.q_decide",
    "rebound.plans.q_explain",
    "rebound.plans.q_eval",
    "rebound.plans.q_streams",
    "rebound.plans.q_models",
    "rebound.plans.q_misc",
]


def load() -> dict:
    for m in MODULES:
        importlib.import_module(m)
    return REGISTRY
