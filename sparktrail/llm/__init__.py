"""Training-data operators.

Ten operators for corpus preparation plus the thin ``opN_*`` queries that
apply them to the whole test tables.  Nothing else in the library imports
this subpackage.
"""
