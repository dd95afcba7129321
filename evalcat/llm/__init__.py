"""Training-data operators: packing, vector and text near-duplicates, WARC
archives, license scans, language-model scores, quality and toxicity
classifiers, benchmark decontamination and token files.

Nothing outside this subpackage imports it."""
