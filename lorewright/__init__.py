"""Analytics over wiki-like text collections, knowledge graphs and retrieval, as Spark dataflows."""
