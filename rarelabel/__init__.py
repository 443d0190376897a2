"""DataFrame operators for classification on large, imbalanced tables."""
