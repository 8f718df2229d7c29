"""Part of quarrylens."""
