"""Compositions of operators: index build, index verification, search, chat audit."""
