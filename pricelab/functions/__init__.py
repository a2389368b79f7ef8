"""Column-level functions: fixed values, text rendering/parsing, scalar helpers."""

from . import constants, scalar, text  # noqa: F401
