"""What is asked of a model and its tuples, for whole batches."""

from .check import batch_check, check, run_assertions
from .expand import expand, expand_rows
from .listing import list_objects, list_users

__all__ = ["batch_check", "check", "expand", "expand_rows", "list_objects", "list_users", "run_assertions"]
