"""Training-data operators: dedup, decontamination, tokens, scores and scans over `documents`.

Nothing outside this subpackage imports it; deleting it leaves the rest of the library whole.
"""
