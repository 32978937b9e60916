"""Operators that prepare training corpora: language ID, chat formatting, fingerprints, mixing,
personal data, WARC archives, token counts, near-duplicates, toxicity and decontamination.

Nothing outside this subpackage imports it."""
