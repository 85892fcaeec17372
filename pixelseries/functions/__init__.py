"""Column functions: scalar rules of the optical, radar, grid and feature operators."""
