"""Scalar functions: datatype value spaces and facets."""
