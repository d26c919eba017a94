"""Training-data operators: deduplication, decontamination, quality, tokenisers and token files.

Nothing outside this package imports it. Every operator takes DataFrames and column
names, so tables with other columns, or with clashing names, pass through unharmed.
"""
