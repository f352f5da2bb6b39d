"""Text-retrieval analytics on Spark: every operator is a DataFrame in, DataFrame out transformation."""
