"""Multi-version key/value analytics on PySpark: versions, snapshots, transactions, compaction."""
