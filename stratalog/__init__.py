"""Analytics over log-structured key-value data, expressed as Spark plans."""
