"""Schemas of the core tables. Open-ended metadata goes to map<string,string>."""

from __future__ import annotations

SLIDES = "slide_id long, path string, format_id string, slide_family string, width long, height long, level_count int, step int, mpp double, properties map<string,string>"
LEVELS = "slide_id long, level int, width long, height long, downsample double"
TILES = "slide_id long, level int, z int, channel int, col int, row_no int, x0 long, y0 long, cov_w int, cov_h int, offset long, length long, data binary"
BLOCKS = "slide_id long, block_id long, col int, row_no int, n_x int, n_y int"
CHANNELS = "slide_id long, channel_index int, name string, source_name string, metal string, mass double, path string"
SCENES = "slide_id long, scene_index int, x long, y long, w int, h int"
PLANES = "slide_id long, channel_index int, level int, height int, width int, dtype string, data binary"
REQUESTS = "request_id long, slide_id long, x long, y long, level int, w int, h int, biomarker string"
RASTER = "struct<height: int, width: int, n_channels: int, mode: string, data: binary>"
ASSOCIATED = f"slide_id long, name string, image {RASTER}"
COLOR_STYLES = "style string, gamma double, ccm array<double>, rgb_rate array<double>"
