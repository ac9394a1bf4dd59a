"""Analytics over block-structured ledgers and other append-mostly data, on Spark."""
