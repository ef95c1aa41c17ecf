"""Structured Streaming jobs. Late rows: watermark of ten minutes unless a job says otherwise."""
