"""Ontology data model: entities, expressions, axioms and literals."""
