"""Analytics over large text and source corpora as Spark DataFrame queries."""
