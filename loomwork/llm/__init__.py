"""Training-data operators: language, toxicity, quality, near duplicates, decontamination, packing and formats.

Nothing outside this folder (and corpus_pipeline.py) imports it; `queries.py` registers one query per operator.
"""
