"""Training-data operators: scoring, near-duplicate search, extraction, packing.

Every operator reads only the columns it names, so further columns (whatever
their names) never disturb it, and treats a null text as an empty one.
"""
