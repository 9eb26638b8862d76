"""Compaction, deduplication, ranking and accounting of text for language-model contexts, as DataFrame operators."""
