"""Training-data operators: decontamination, token output, packing, near-duplicates, filters and scores.

The subpackage stands alone: nothing else in the library imports it.
"""
