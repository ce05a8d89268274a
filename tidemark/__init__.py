"""Analytics over observed entities, written for Spark."""
