"""Column-expression builders.  Everything here returns a ``Column`` that stays
inside Spark's generated code; there is no Python UDF in this package."""
