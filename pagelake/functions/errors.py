"""Error classes as they appear in the ``error_class`` column."""

from __future__ import annotations


class DocumentError(Exception):
    kind = "Corrupt"


class NotADocument(DocumentError):
    kind = "NotXdw"


class Corrupt(DocumentError):
    kind = "Corrupt"


class Unsupported(DocumentError):
    kind = "Unsupported"


class Protected(DocumentError):
    kind = "Protected"


class TooLarge(DocumentError):
    kind = "TooLarge"

    def __init__(self, limit: str, text: str = ""):
        super().__init__(f"{limit}: {text}" if text else limit)
        self.limit = limit
