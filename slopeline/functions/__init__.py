"""Column-level building blocks: losses, keyed sampling, vector maths, label projections."""
