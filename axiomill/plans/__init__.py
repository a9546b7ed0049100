"""Compilation of axioms to rule programs, and their evaluation as DataFrame plans."""
