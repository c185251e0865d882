"""Sources: trackers and the demo hits."""
