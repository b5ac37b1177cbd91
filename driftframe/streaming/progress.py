"""Progress events: one JSON line for every thousand rows scanned, and a last one."""

from __future__ import annotations

import json
from typing import TextIO


class Progress:
    """Versions report as their scans end, the baseline first; an event for each thousand rows passed on the way."""

    def __init__(self, out: TextIO, every: int = 1000):
        self.out, self.every, self.rows, self.said = out, every, 0, 0
        self.file, self.bytes = "", 0

    def scanned(self, file_id: str, rows: int, bytes_written: int = 0) -> None:
        """More rows of a file; bytes_written: of all files so far."""
        self.rows += rows
        self.file, self.bytes = file_id, bytes_written
        for at in range(self.said + self.every, self.rows + 1, self.every):
            self.emit(at)

    def emit(self, rows: int) -> None:
        self.said = rows
        self.out.write(json.dumps({"bytesWritten": self.bytes, "currentFile": self.file, "rowsScanned": rows, "type": "PROGRESS"}, separators=(",", ":"), ensure_ascii=False) + "\n")
        self.out.flush()

    def finish(self, baseline: str) -> None:
        if self.said != self.rows or not self.rows:
            self.file = self.file or baseline
            self.emit(self.rows)
