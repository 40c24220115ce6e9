"""Column functions: geometry, codes, projections, scores, labels."""
