"""Training-data operators: quality, packing, similarity, decontamination, scoring, token counts.

One module per operator (general interface), ``queries.py`` for the registered queries. Nothing else
in the library imports this subpackage.
"""
