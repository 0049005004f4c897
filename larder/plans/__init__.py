"""Jobs that chain several operators and write their results."""
