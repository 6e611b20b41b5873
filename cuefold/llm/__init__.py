"""Operators of a training-data pipeline: quality, duplicates, decontamination, language, packing, models."""
