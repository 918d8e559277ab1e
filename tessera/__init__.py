"""Analytics over large text collections, expressed with Spark DataFrames."""
