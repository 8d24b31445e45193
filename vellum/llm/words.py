"""Words between ASCII white space, as bytes, in lists of bounded length."""

import re
from collections.abc import Iterator

SPACE = re.compile(rb"[ \t-\r]")
BLOCK = 4 << 20


def word_lists(data: bytes, block: int = BLOCK) -> Iterator[list[bytes]]:
    """The words of UTF-8 text in order, a few megabytes at a time; cut only at white space."""
    start = 0
    while len(data) - start > block:
        cut = SPACE.search(data, start + block)
        if not cut:
            break
        yield data[start:cut.start()].split()
        start = cut.start()
    yield (data[start:] if start else data).split()
