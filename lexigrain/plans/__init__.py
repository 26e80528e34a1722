"""Query language (parser and planner) and index configuration inferred from a schema."""
