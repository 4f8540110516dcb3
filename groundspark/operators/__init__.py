"""Operators over tables of documents, chunks, questions, answers and events."""
