"""Plans: the registered query catalogue, chart-spec execution and plan checks."""
