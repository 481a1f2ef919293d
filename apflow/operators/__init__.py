"""Reusable DataFrame -> DataFrame operators (rates, grain, lookups, profiling)."""
