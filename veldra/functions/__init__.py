"""Part of veldra."""
