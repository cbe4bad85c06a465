"""Operators over large texts and numeric columns for training data."""
