"""Readers and writers of corpora, sidecar files and logs."""
