"""Reading landed files and stored tables, writing tables."""

from curbside.sources.landing import DriftError, LandingScan, NoLandedFilesError, scan_landing
from curbside.sources.scratch import materialise, scratch_path
from curbside.sources.sinks import overwrite_table, own_session, side_by_side
from curbside.sources.tables import TooManyRowsError, from_rows, hand_over, is_stored, preview, read_table

__all__ = [
    "DriftError",
    "LandingScan",
    "NoLandedFilesError",
    "TooManyRowsError",
    "from_rows",
    "hand_over",
    "is_stored",
    "materialise",
    "overwrite_table",
    "own_session",
    "preview",
    "read_table",
    "scan_landing",
    "scratch_path",
    "side_by_side",
]
