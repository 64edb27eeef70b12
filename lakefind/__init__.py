"""Hybrid document retrieval and corpus analytics expressed as Spark DataFrame operators."""
