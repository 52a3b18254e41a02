"""Training-data operators over Spark DataFrames; nothing else in the library imports this subpackage."""
