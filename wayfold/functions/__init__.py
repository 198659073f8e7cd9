"""Part of the wayfold package."""
