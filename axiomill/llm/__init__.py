"""Training-data operators: quality, dedup, token output, language, toxicity, urls, search, decontamination.

Nothing outside this subpackage imports it. ``registry`` lists its queries.
"""
