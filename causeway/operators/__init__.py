"""Analyses over trace tables."""
