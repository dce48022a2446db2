"""Operators of a training-data pipeline: mixing, language identification,
quality scoring, page extraction, line and document de-duplication, URL
filters, decontamination, vector links and token files.

Nothing outside this package imports it; ``__spark_entry__.py`` registers its
queries when it is present.
"""
