"""Part of telar; see README.md."""
