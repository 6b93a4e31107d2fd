"""Column functions: statistics that Spark lacks or defines differently, and the scoring rules."""
