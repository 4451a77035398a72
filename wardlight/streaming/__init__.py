"""Structured Streaming jobs. Each shares its operators with the batch form.

Every job writes one folder per micro-batch (see ``sources.sinks``). A batch
that runs again after a lost executor or driver replaces its own folder and
reads only the folders of earlier batches, so a retry changes nothing.
"""
