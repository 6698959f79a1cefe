"""Movement-graph analytics and training-data operators on PySpark."""
