"""Scalar functions over names, titles, codes and identifiers, as column expressions."""

from concordat.functions.text import *  # noqa: F403
