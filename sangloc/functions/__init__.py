"""Column functions: text cleaning, addresses, money amounts and text metrics.

Everything here is ``Column -> Column`` and runs inside one row, so it works the
same in batch and streaming plans and never causes a shuffle.
"""
