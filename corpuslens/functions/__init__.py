"""Column expressions shared by all operators. Each stays on the JVM side."""

from .columns import *  # noqa: F403
