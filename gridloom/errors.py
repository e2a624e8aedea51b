"""The one exception type of the library: a stable code plus a message."""

from __future__ import annotations


class WorkspaceError(Exception):
    def __init__(self, code: str, message: str) -> None:
        super().__init__(f"{code}: {message}")
        self.code = code
        self.message = message

    def __reduce__(self):
        return (WorkspaceError, (self.code, self.message))
