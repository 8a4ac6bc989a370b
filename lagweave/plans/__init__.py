"""Query catalogues and multi-step plans."""
