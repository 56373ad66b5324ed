"""Growing shard folders as a stream."""
