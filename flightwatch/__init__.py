"""Vehicle-telemetry analytics on Spark: cleaning, labelling, windows, scoring."""
