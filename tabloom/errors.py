"""The one exception callers handle."""


class TableError(ValueError):
    """A fault of a table or of a request.

    `code` is for programs, the text and `action` for people; `row` and `column` tell the place where it is known. Cell
    values are never part of it.
    """

    def __init__(self, code, message, action="", **place):
        super().__init__(message)
        self.code, self.message, self.action, self.place = code, message, action, place

    @property
    def row(self):
        return self.place.get("row")

    @property
    def column(self):
        return self.place.get("column")
