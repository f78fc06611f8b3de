"""Empty on purpose: the operators are batch operators, and what is incremental works on modules (operators/incremental.py)."""
