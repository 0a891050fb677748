"""Part of the opportunity-ranking library."""
