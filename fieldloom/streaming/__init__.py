"""The same rules over unbounded inputs."""

from .split import start_split

__all__ = ["start_split"]
