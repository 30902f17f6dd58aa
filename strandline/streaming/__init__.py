"""Structured Streaming forms of sequence operators. Each function takes and returns a streaming DataFrame; the
caller writes it. Keyed state carries what an earlier batch left, so batches may cut a stream anywhere."""
