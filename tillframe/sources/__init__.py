"""Inputs: CSV order lines, and the star-schema tables reshaped to the two input frames."""
