"""Operators for training text: cleaning, near copies, decontamination, scans, formats and packing.

Nothing else in the library imports this package.
"""
