"""Streaming: the reference has no stream, watermark or stateful analytics, so none is built.

``uploads`` re-expresses the reference's upload flow (workbook → prepared tables → stored
dataset + catalog row) as a Structured Streaming file source over an uploads folder with a
``foreachBatch`` sink into the dataset store.
"""
