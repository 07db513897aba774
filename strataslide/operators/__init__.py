"""Operators on slides, levels, tiles, channels and requests, as DataFrame plans."""
