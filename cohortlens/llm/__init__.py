"""Training-data operators: one module per operator, queries and oracle SQL in ``queries``.

Nothing outside this folder imports it except the guarded import in ``__spark_entry__``.
"""
