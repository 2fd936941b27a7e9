"""The tables' schemas."""

from __future__ import annotations

CRAWL_ROW = "channel string, url_html string, url_rel_html string, url_rst string, url_sources_txt string, source_used string, status string, section_title string, rst_text string, error string"
CLEANED_DOC = "file string, title string, text string, code_blocks array<struct<lang: string, code: string>>, index long, label string"
SECTION = "file string, label string, title string, text string, parent_index long, index long"
_PERSON = "author struct<login: string>, bodyText string"
DISCUSSION = f"title string, url string, createdAt string, answerChosenAt string, author struct<login: string>, bodyText string, answer struct<{_PERSON.replace(' ', ': ', 1).replace(', bodyText ', ', bodyText: ')}>, comments array<struct<bodyText: string>>, label string, file string, index long"
DISCUSSION_NODE = (
    "title: string, url: string, createdAt: string, answerChosenAt: string, author: struct<login: string>, bodyText: string, "
    "answer: struct<author: struct<login: string>, bodyText: string>, comments: struct<nodes: array<struct<author: struct<login: string>, bodyText: string>>>"
)
RAG_DOC = "label string, file string, index long, title string, text string"
DOCUMENT = "index long, source_type string, path string, text string, func_name string, docstring_summary string, title string"
REQUEST = "id long, query string, query_type string, type string"
_RELEVANT = "file: string, entry_filename: string, path: string, index: long, doc_index: long, func_name: string, docstring_summary: string, text: string, score: double, heuristic_score: double"
GROUND_TRUTH = f"query string, query_type string, relevant_docs array<struct<{_RELEVANT}>>, notes string"
_FOUND = "index: long, path: string, source_type: string, func_name: string, display: string"
RESULT = f"query_id long, query string, query_type string, retrieved_docs array<struct<{_FOUND}>>, scores array<double>, latency double"
