"""Scalar functions over values that remember how they can fail."""
from .scalars import *  # noqa: F403
from .values import BuildError, Failure, Val, field, if_, ifs, literal, switch, val  # noqa: F401
