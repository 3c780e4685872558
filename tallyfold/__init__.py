"""tallyfold: product and market analytics on Spark DataFrames.

``sources``    read tables and CSV, preview and profile them
``functions``  column expressions (text, numbers, dates, bands)
``operators``  DataFrame -> DataFrame building blocks
``jobs``       whole business metrics composed of the building blocks
``plans``      the registered queries and their SQL twins
"""
