"""Column expressions. Every function here returns a ``Column``; none needs a UDF."""
