"""Part of lociframe; see README.md."""
