"""Where intermediate tables live, and how they are written and read again."""

from ..storage import Stored, new_path, open_shared, shared_dir, stored

__all__ = ["Stored", "new_path", "open_shared", "shared_dir", "stored"]
