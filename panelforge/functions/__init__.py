"""Column functions: built-in expressions only."""

from .columns import *  # noqa: F403
