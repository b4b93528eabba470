"""Exploring, charting, detecting, ruling, enriching and annotating events."""
