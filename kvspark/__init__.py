"""Versioned key/value analytics as DataFrame plans: logs, folds, lookups, filters, runs and codecs."""
