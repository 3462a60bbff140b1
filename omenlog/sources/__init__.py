"""Readers and writers for logs, labels, scores, splits and reports."""
