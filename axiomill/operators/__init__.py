"""Relational building blocks shared by the engine."""
