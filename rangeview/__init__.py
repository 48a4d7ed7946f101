"""Bounded, positional previews of tables, structured documents and text as Spark DataFrames."""
