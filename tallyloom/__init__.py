"""Tallyloom: retail price intelligence and training-corpus preparation on Spark."""
