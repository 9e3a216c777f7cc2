"""Training-data operators: packing, token files, chat windows, piece matching, deduplication, scoring, archives.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries when it is present.
"""
