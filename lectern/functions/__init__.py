"""Scalar functions: text folding, names, titles, LaTeX, BibTeX."""
