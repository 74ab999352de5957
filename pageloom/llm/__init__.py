"""Training-data operators over document text (problems 1 to 8).

Nothing outside this subpackage imports it; ``queries`` holds its registered queries.
"""
