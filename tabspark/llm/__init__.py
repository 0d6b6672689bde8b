"""Training-data operators: token files, dedup, archives, chat formatting, packing, language-model
scoring, toxicity, near-dedup, quality and benchmark decontamination."""
