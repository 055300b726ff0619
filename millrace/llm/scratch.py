"""Tables written between steps, in the shared folder that the session names: those of :mod:`millrace.tables`."""

from ..tables import clear, cut, delete, discard, exists, fresh, own_folder, shared_folder

__all__ = ["clear", "cut", "delete", "discard", "exists", "fresh", "own_folder", "shared_folder"]
