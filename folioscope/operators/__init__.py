"""Operators over works, profiles and their graph: DataFrame in, DataFrame out."""
