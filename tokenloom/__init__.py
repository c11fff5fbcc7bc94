"""Design-system analytics on Spark: extraction, reconciliation, inference and serving of design tokens."""
