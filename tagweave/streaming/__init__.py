"""File-source streams of tag texts."""
