"""Queries of this subpackage, by name, and the SQL of those that SQL can express."""

from shelfwise.llm import (decontamination, filter_audit, hard_negatives, html_extraction, packing, phrase_dedup, piece_bpe, pii, preference,
                           quality_rules, simhash, suffix_dedup, url_filters)

QUERIES = (simhash.QUERIES | url_filters.QUERIES | packing.QUERIES | quality_rules.QUERIES | decontamination.QUERIES | pii.QUERIES
           | preference.QUERIES | phrase_dedup.QUERIES | suffix_dedup.QUERIES | html_extraction.QUERIES | filter_audit.QUERIES
           | piece_bpe.QUERIES | hard_negatives.QUERIES)
ORACLE = url_filters.ORACLE | quality_rules.ORACLE | filter_audit.ORACLE | hard_negatives.ORACLE
