"""Scalar functions: amounts, dates, number formats, text similarity, scores."""
