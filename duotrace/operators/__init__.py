"""The operators of a search: DataFrame in, DataFrame out."""
