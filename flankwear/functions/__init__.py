"""Column-expression helpers (all JVM-side built-ins)."""
from flankwear.functions.scalar import *  # noqa: F401,F403
