"""Column functions: time, positions, partition transforms, logical types."""
