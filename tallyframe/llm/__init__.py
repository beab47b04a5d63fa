"""Operators that prepare training data for language models.

Nothing outside this subpackage imports it. Common rules: the operators keep every column of their input, add their own
(an input column of such a name is replaced), treat a null text as the empty text and keep every row unless removal is
their purpose.
"""
