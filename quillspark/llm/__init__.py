"""Operators that prepare training text: decontamination, dedup, language, quality, mixing, chat."""
