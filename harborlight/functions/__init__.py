"""Column functions: geodesy, scores and thermal arithmetic."""
