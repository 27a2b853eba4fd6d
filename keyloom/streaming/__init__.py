"""The run-lifecycle operators applied to an unbounded event feed."""
