"""Feed re-ranking and generation evaluation as Spark jobs.

Every operator takes DataFrames and returns a DataFrame; nothing runs until
the caller acts on the result, except where a docstring says otherwise.
"""
