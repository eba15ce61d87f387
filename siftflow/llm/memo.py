"""A bounded memo of what chunks of text encode to."""

from __future__ import annotations

from collections.abc import Callable

#: Longest chunk that is kept.
MEMO_CHARS = 48


class ChunkMemo(dict):
    """Chunk to encoded bytes. The first ``kept`` chunks stay for good; after them, two generations of ``recent``.

    The bounds limit memory only: a chunk that isn't held is encoded again. Look chunks up with ``memo[chunk]``.
    """

    def __init__(self, encode: Callable[[str], bytes], kept: int, recent: int = 50_000):
        super().__init__()
        self.encode_chunk, self.kept, self.size = encode, kept, recent
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def __missing__(self, chunk: str) -> bytes:
        found = self.recent.get(chunk) or self.older.get(chunk)
        if found is None:
            found = self.encode_chunk(chunk)
            if len(chunk) > MEMO_CHARS:
                return found
            if len(self) < self.kept:
                self[chunk] = found
                return found
            if len(self.recent) >= self.size:
                self.older, self.recent = self.recent, {}
            self.recent[chunk] = found
        return found
