"""Source text to declarations.

The modules here are the small per-file helpers that run inside Spark tasks: they find where
declarations stand in one text. Ids, signatures, edges, references and counts are column work in
`codeskein.operators.symbols`.
"""
