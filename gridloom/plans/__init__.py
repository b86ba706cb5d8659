"""Query plans: the operators applied to the input tables."""
