"""Training-data operators: each is a function over ``documents``-like DataFrames.

Nothing outside this package imports it; ``pricewise.llm.queries`` registers its queries.
"""
