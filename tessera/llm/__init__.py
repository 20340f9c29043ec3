"""Training-data pipeline operators (one module per operator).

Nothing outside this package imports it; ``queries.py`` holds the
registered queries and their SQL.
"""
