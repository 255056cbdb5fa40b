"""Streams of readings: windows, duplicates, steps and scoring."""
