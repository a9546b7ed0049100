"""Ontology reasoning, conjunctive queries and corpus preparation on Spark."""
