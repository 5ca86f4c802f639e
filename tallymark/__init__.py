"""Tallymark: a Spark-first engine for catalogue resolution, price analytics and corpus preparation."""
