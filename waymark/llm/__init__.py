"""Operations of a large-scale training-data pipeline over Spark tables of texts.

Nothing else in the library imports this subpackage.
"""
