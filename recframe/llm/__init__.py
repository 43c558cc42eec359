"""Training-data operators: decontamination, search, licences, sharding,
substring and near-duplicate removal, toxicity, tokenising and chat formatting.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
``queries.py`` registers one query per operator."""
