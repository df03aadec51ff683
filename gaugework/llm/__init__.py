"""Operators for training text: scores, duplicates, decontamination, extraction, mixing, chat."""
