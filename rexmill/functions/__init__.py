"""Pattern functions over columns and in SQL."""

from .columns import *  # noqa: F403
from .sql import find_all_table, register

__all__ = [n for n in dir() if not n.startswith("_")] + ["find_all_table", "register"]
