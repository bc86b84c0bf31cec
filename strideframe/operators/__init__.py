"""Operators over detections and tracks."""
