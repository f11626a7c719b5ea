"""Training-data operators: privacy, quality, deduplication, formatting, decontamination, media, mixing.

Nothing outside this package imports it.  Each module holds one operator with a general interface; ``queries`` binds
them to the tables with production parameters and ``oracles`` has the SQL to hold them against.
"""
