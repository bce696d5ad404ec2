"""Text and numbers together, as Spark DataFrames.

Every operator takes DataFrames (documents, rows, links, ...) and returns a lazy DataFrame.
"""
