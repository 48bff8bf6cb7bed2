"""ember: wildfire raster analytics as composable Spark DataFrame operators.

Imagery lives in *pixel tables* (one row per ``chip_id, rw, cl``) or in *chip
tables* (one row per chip, bands as arrays).  A chip is bounded by contract
(at most 512 x 512 pixels, see ``operators.contracts.check_bands``); every
operator spreads work over chips, rows or tiles and never over a single task.
"""

__version__ = "0.1.0"

#: Largest chip the data model admits, in pixels per side.
MAX_CHIP_SIDE = 512

#: Label value that marks pixels without ground truth.
IGNORE_LABEL = 255
