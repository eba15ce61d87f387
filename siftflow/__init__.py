"""Network-flow analytics on Spark: sources, window features, rules, scoring and reports."""
