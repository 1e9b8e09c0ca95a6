"""Training-data operators: ten document-scale jobs and the queries that apply them.

Nothing outside this subpackage imports it.  Every operator takes DataFrames and
returns a DataFrame; Python code inside tasks only sees one Arrow batch or one
bounded group at a time.
"""
