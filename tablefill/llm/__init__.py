"""Operators of a training-data pipeline, one module each.

Nothing outside this package (and ``corpus_pipeline.py``) imports it; the
package and its tests can be removed without touching the rest.
"""
