"""Training-data operators: dedup, decontamination, quality, tokenisation, language models, web archives.

Nothing else in the library imports this subpackage.  Submodules are imported
by name; this file stays empty so that an executor loads only what it runs.
"""
