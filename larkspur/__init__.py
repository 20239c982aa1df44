"""Job-market analytics on Spark: listings, shards, request usage, forum and text extraction."""
