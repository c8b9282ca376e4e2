"""Operations of a training-data pipeline: one module per operator, ``queries`` registers them.

Nothing outside this package (and ``corpus_pipeline.py``) imports it.
"""
