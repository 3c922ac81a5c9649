"""PySpark-native tabular regression engine: profile, prepare, fit, rank, evaluate, explain, score, history."""
