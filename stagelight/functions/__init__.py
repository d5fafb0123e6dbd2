"""functions of the imaging-run analytics library."""
