"""Structured Streaming jobs: label-correction upsert and account scoring.

Both read a file source with an explicit schema, keep a checkpoint under
the shared checkpoint folder, and can run continuously or with
``trigger(availableNow=True)`` to drain what is there and stop.
"""
