"""Operators for language-model training data: corpus encoding, source mixing, subject areas."""
