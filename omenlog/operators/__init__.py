"""DataFrame operators: each takes and returns DataFrames and builds one lazy plan."""
