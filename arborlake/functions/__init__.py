"""Part of the arborlake engine."""
