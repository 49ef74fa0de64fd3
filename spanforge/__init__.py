"""spanforge: traces, logs and metrics as Spark tables, with the operators to analyse them."""
