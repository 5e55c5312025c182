"""Spark-native categorical encoding and evaluation.

The package is organised by what a step does to a DataFrame:

``sources``    reading raw files, role catalogues, run records, cached builds
``functions``  column expressions: hashing, cleaning, string similarity
``operators``  table-level steps: ranks, preparation, joins, profiles, encoders, splits, metrics
``plans``      compositions: dataset recipes, feature building, models, experiments, reports
``suite``      the checked queries, each beside its plain SQL counterpart
"""
