"""Readers of headers, example files and saved models, and writers of reports."""
