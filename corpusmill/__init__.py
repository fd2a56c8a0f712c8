"""corpusmill: text-corpus quality, leakage, perturbation and training-data operators on Spark DataFrames."""
