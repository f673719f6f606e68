"""Readers and writers of manifests, metadata, transcripts, trials and shards."""
