"""Part of capweave; see README.md."""
