"""Readers of the engine's own file formats."""
