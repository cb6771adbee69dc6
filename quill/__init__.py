"""A document-analytics engine on Spark: sources, column functions, operators, plans and streaming."""
