"""Models, calibration and the whole linkage."""
