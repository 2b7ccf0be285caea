"""Operators of a training-data pipeline: tokens, packing, duplicates, decontamination, personal data, quality, licences, exact search."""
