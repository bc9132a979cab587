"""siftline: search, ranking, deduplication and text-corpus operators as PySpark DataFrame transforms."""
