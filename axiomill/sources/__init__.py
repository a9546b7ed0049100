"""Ontology sources and text sinks."""
