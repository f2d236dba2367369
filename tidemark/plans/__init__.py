"""Strategies: transforms applied one after another."""
