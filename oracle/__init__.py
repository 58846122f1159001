"""SQL counterparts of the analyses, for checking results in another engine."""
