"""Training-data operators: each module is one operator, ``queries`` registers them.

Every operator takes a DataFrame and names its columns by parameter; columns it
does not need are ignored or passed through untouched, so extra columns with any
name are harmless.  A null text counts as empty unless the operator says otherwise.
"""
