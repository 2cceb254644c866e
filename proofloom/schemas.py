"""Schemas of inputs; rows that do not fit give nulls, never failures."""

from __future__ import annotations

REQUIREMENT = "requirement_id string, title string, verification_status string, ord long"
TEST_LOG = """release_candidate string, module string, timestamp string, test_environment string,
    metrics struct<coverage: int, failed_tests: int, bypassed_checks: int>,
    requirement_results array<struct<requirement_id: string, result: string, suite: string, detail: string>>,
    static_analysis struct<misra_c_violations: int, warnings: int>"""
CLAUSE = "clause_id string, title string, text string, section string, page_start int, source_document string"
RULE = "rule_id string, clause_id string, clause_title string, modality string, requirement_text string, condition string, action string, category string, severity string, confidence double, source_document string"
EMAIL = "path string, subject string, from_addr string, to_addr array<string>, sent timestamp, body string, attachments array<string>"
DOCX = "path string, title string, headings array<struct<level: int, text: string>>, tables array<array<string>>, paragraphs array<string>, full_text string"
CHUNK = "chunk_id string, document_id string, chunk_index int, text string, metadata map<string,string>, embedding array<double>"
