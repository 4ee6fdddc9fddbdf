"""Training-data operators: licences, line and document dedup, decontamination, scoring, language, packing, chunk dedup."""
