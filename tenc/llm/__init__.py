"""Operations of a training-data pipeline over a table of documents.

Each module holds one operator with its own interface; ``suite`` registers the queries.
"""
