"""Domain pipelines composed from the operators, and the driver queries."""
