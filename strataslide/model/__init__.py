"""Tables of the data model: slides, levels, tiles, channels, scenes, planes and requests."""
