"""Analytics over paged documents on Spark."""
