"""Streaming: incremental ingest of ACS files as they arrive.

The original library has no streaming operator; every step there is batch.
The one step that is meaningful per micro-batch is the ingest (a vintage's
files arrive over time), so this package offers exactly that: a file-source
stream whose micro-batches are scanned by the batch scanner and appended to
an append-only cell log; the merged panel is a read of that log.  The
per-year standardization needs a complete year and stays a batch job.
"""
