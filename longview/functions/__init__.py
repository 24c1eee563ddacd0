"""Column functions: error metrics and reproducible picks."""
