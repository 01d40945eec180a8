"""Operators for preparing language-model training data.

Nothing outside this package imports it: the raster and weather engine works
the same when the folder is absent.
"""
