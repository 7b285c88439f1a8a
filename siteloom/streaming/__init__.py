"""Event logs as streams: the batch operators' results, kept up while the log grows."""
