"""Operations of a training-data pipeline: scans, filters, deduplication, tokenisation and sharding."""
