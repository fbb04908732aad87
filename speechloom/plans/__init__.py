"""Reusable physical-plan patterns: blocked scans, chained block folds, guarded lookups."""
