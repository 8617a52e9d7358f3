"""Training-data operators: ten large-corpus operators and their queries.

Nothing outside this subpackage imports it; it can be removed as a folder.
"""
