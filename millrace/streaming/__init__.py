"""Streams are bounded inputs here: the operator inventory has no windows over arrival, no watermarks and no state, so there is nothing in this package.

Bags are DataFrames; those made by ``spark.readStream`` go through the row-by-row methods (map, filter, collect, map_flatten, by) unchanged.
"""
