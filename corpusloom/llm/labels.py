"""Label lists that are stored as text; the decoder is one of the core's functions."""

from corpusloom.functions.labels import WHITE_SPACE, bound, decode_labels, letters_digits, strip

__all__ = ["WHITE_SPACE", "bound", "decode_labels", "letters_digits", "strip"]
