"""Operators for large-scale training-data pipelines; nothing else in docket imports them."""
