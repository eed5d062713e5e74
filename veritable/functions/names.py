"""Column names as people spell them."""

from __future__ import annotations

import re


class Names:
    """Lookup of a table's columns by spelling.

    Every column is entered under its exact name and under its loose spelling
    (no case, blanks or underscores). An exact name wins; of columns with the
    same loose spelling the first in the table does.
    """

    def __init__(self, columns):
        self.columns = list(columns)
        self.index = {self.loose(c): c for c in reversed(self.columns)} | {c: c for c in self.columns}

    @staticmethod
    def loose(name: str) -> str:
        return re.sub(r"[\s_]+", "", name).casefold()

    def find(self, name) -> str | None:
        text = str(name)
        return self.index.get(text, self.index.get(self.loose(text)))
