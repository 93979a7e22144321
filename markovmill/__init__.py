"""Mixture-of-Markov-chains text models as Spark DataFrames."""
