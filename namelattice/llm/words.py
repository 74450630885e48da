"""Words of a text as bytes, by the definition that operators on words share.

``A-Z`` are lower-cased and a word is a run of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``:
every ASCII byte other than a digit or a lower-case letter separates, every
other character (all its UTF-8 bytes are 0x80 or more) belongs to a word.  So a
byte table and ``split`` do the whole job on undecoded text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc

_TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)
#: The same as DataFrame and DuckDB regular expression, over lower-cased text.
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def byte_rows(column: pa.Array | pa.ChunkedArray) -> Iterator[bytes]:
    """Each text of an Arrow string column as its bytes, null as empty, without decoding."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    for chunk in chunks:
        binary = chunk.cast(pa.large_binary() if pa.types.is_large_string(chunk.type) else pa.binary())
        for value in binary:
            yield value.as_buffer().to_pybytes() if value.is_valid else b""


def separated(texts: pa.Array) -> pa.Array:
    """``texts`` as a string array, null as empty, lower-cased and with a space for each separating byte, in one pass over their bytes."""
    strings = pc.fill_null(texts, "")
    strings = strings if pa.types.is_string(strings.type) else strings.cast(pa.string())
    _, offsets, data = strings.buffers()
    return pa.StringArray.from_buffers(len(strings), offsets, pa.py_buffer((data.to_pybytes() if data else b"").translate(_TABLE)), offset=strings.offset)
