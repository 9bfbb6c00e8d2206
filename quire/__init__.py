"""Spark jobs over large corpora of structured documents."""
