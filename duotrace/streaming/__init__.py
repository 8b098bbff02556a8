"""The search's grouping steps on unbounded streams."""
