"""Readers of the input relations."""

from millrace.sources.tables import chunk_files, read_chunks, read_csv_pairs, read_json, read_labels, read_profiles, read_table, read_text, read_words

__all__ = ["chunk_files", "read_chunks", "read_csv_pairs", "read_json", "read_labels", "read_profiles", "read_table", "read_text", "read_words"]
