"""Closed-vocabulary question plans and the end-to-end analysis pipeline."""
