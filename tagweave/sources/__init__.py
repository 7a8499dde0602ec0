"""Folders of images and side texts, as tables, and sinks for them."""
