"""Training-data operators: each module holds one operator and its general interface.

Nothing outside this folder imports it; ``queries.py`` holds the thin registered queries.
"""
