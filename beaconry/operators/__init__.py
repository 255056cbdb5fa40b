"""Relational operators: neighbours, ranging, sequences, metrics, statistics, splits."""
