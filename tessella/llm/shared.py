"""What several corpus operators use of the library: scratch tables and connected components."""

from tessella.operators.components import connected_components
from tessella.scratch import new_path, remove, shared_root, written

__all__ = ["connected_components", "new_path", "remove", "shared_root", "written"]
