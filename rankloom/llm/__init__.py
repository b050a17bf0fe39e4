"""Training-data operators: each module is one operator, plus the thin queries over the standard tables.

Nothing outside this subpackage (but for the guarded registration) imports it.
"""
