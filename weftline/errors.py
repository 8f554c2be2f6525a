"""Errors of the catalog and the front ends; what Spark finds wrong is raised by Spark."""

from __future__ import annotations


class WeftlineError(Exception):
    pass


class AlreadyExists(WeftlineError):
    def __init__(self, kind: str, name: str):
        super().__init__(f"{kind} {name!r} already exists")


class NoSuchObject(WeftlineError):
    def __init__(self, kind: str, name: str):
        super().__init__(f"there is no {kind} {name!r}")


class SyntaxProblem(WeftlineError):
    """Text that can't be read, with its place."""

    def __init__(self, text: str, at: int, message: str):
        line = text.count("\n", 0, at) + 1
        column = at - (text.rfind("\n", 0, at) + 1) + 1
        super().__init__(f"line {line}, column {column}: {message}")
        self.line, self.column = line, column
