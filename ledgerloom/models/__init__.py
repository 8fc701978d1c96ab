"""Scorers and the detection cascade."""
