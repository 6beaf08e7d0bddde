"""Operators of a training-data pipeline over the workbench's text, vector and link records.

Notes (``notes.id``, ``notes.text``), enrolled embeddings (``face_embeddings.id``, ``embedding``)
and sources (``sources.id``, ``url``) are the records they work on.  Nothing outside this
subpackage imports it; ``queries`` holds the registered queries.
"""
