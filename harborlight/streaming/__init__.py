"""Stateful operators over streams of passes, labels and files."""
