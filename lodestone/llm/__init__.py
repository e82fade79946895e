"""Training-data operators: one module for each, ``registry`` holds their queries and SQL."""
