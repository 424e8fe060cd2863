"""Training-data operators: filters, fingerprints, search, tokenisation, mixing and fixity.

Nothing outside this subpackage imports it.
"""
