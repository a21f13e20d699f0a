"""Registered queries by subject; importing this package registers them all."""

from valuegate.plans import evaluation, gate_plans, profiling, resolution, search_plans, streams, surface, text_plans

MODULES = (evaluation, gate_plans, profiling, resolution, search_plans, streams, surface, text_plans)
