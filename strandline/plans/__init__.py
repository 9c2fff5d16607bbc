"""Whole detections, and the queries registered for the driver's tables."""
