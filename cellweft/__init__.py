"""Table-corpus preparation and prediction scoring as Spark DataFrame operators."""
