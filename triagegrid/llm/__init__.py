"""Operators of a training-data pipeline: mixing, near copies, decontamination, repeats, search, archives, models, chat."""
