"""Sources and sinks of rasters and areas of interest."""
