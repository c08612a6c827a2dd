"""Dialogue-corpus analytics as plain functions on Spark DataFrames."""
