"""Pairwise funding analytics as Spark jobs.

``sources``    reading and writing tables, snapshots, models
``functions``  column expressions (no UDFs)
``operators``  DataFrame -> DataFrame steps
``plans``      whole jobs: features, training, decorrelation, funding report
"""
