from . import images, text

__all__ = ["images", "text"]
