"""Shared values of these tests."""

from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SF = "/root/testdata/sf0.001"
