"""Content similarity over large document libraries, as Spark jobs.

DataFrame in, DataFrame out. See README.md for the map of the package.
"""
