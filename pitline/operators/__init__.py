"""Table operators: DataFrame in, DataFrame out, nothing executed on the driver."""
