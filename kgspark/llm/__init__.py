"""Operators for preparing language-model training data.  Nothing else in kgspark imports this."""
