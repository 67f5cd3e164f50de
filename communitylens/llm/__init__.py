"""Training-data operators: near-duplicate joins, language-model scoring,
dedup, quality models, token counts, fingerprints, HTML and WARC handling,
byte-level BPE and source mixing.  Nothing outside this package imports it."""
