"""Training-data operators: tokens, duplicates, filters, mixing and classifiers.

Nothing outside this folder imports it.  Every operator takes DataFrames and
column names, reads only the columns it names (extra columns, whatever they
are called, are ignored) and returns a new DataFrame.
"""
