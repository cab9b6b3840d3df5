"""Whole workloads."""
