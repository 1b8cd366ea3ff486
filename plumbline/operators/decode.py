"""Token strings as tokenizers write them, turned into text. For tokens only, never for documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def byte_of_char() -> dict[str, int]:
    """The public byte-level alphabet: printable bytes stand for themselves, the others for characters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in plain}
    for b in range(256):
        if b not in plain:
            out[chr(0x100 + len(out) - len(plain))] = b
    return out


#: Where the second public alphabet begins: byte b is this plus b.
BOXES = 0x2500
_BYTES = byte_of_char() | {chr(BOXES + b): b for b in range(256)}
MARKERS = {"Ċ": "\n", "Ġ": " ", "▁": " "}


class _Bytes(dict[int, str]):
    """Each character's bytes, as characters below U+0100: of the byte alphabets, and, when asked for, of others as UTF-8."""

    def __missing__(self, c: int) -> str:
        return chr(c).encode("utf-8", "surrogatepass").decode("latin-1")


_AS_BYTES = _Bytes({ord(c): chr(b) for c, b in _BYTES.items()})


def _once(token: str) -> str:
    """Characters of a byte alphabet as bytes, others as their own UTF-8; the token itself if that is no valid text."""
    try:
        return token.translate(_AS_BYTES).encode("latin-1").decode("utf-8")
    except UnicodeDecodeError:
        return token


def decoded(token: str | None, rounds: int = 3) -> str | None:
    """A token's text: byte-alphabet characters become bytes if that makes valid UTF-8, again while it changes anything; then markers become blanks."""
    if token is None:
        return None
    for _ in range(0 if token.isascii() else rounds):
        new = _once(token)
        if new == token:
            break
        token = new
    for mark, text in MARKERS.items():
        token = token.replace(mark, text)
    return token


#: Rows that are decoded at once; tokens that a worker remembers with their texts, and the longest of them.
ROWS, REMEMBERED, LONGEST = 64, 1 << 16, 64


class Remembered:
    """Tokens' texts; short tokens recur, so their texts are kept for the rows to come."""

    def __init__(self):
        self.known: dict[str, str] = {}

    def text(self, token: str | None) -> str | None:
        found = self.known.get(token)
        if found is None:
            found = decoded(token)
            if token is not None and len(token) <= LONGEST:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[token] = found
        return found


def _all_decoded(tokens: pa.Array, remembered: Remembered | None = None) -> pa.Array:
    """Lists of tokens decoded, each distinct token once."""
    remembered = remembered or Remembered()
    # A slice's lists begin where it begins; what lies under null lists is left out.
    known = pc.dictionary_encode(tokens.flatten())
    if isinstance(known, pa.ChunkedArray):
        known = known.combine_chunks()
    texts = pa.array([remembered.text(t) for t in known.dictionary.to_pylist()], pa.string()).take(known.indices)
    sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy()
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), texts, mask=tokens.is_null())


def decode(tokens: Column) -> Column:
    """``array<string>`` of token strings as text, in Arrow batches. A few rows' tokens are in memory at once as Python strings, each distinct one once, and so many that recur."""

    @F.arrow_udf("array<string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        remembered = Remembered()
        for batch in batches:
            for i in range(0, len(batch), ROWS):
                yield _all_decoded(batch.slice(i, ROWS), remembered)

    return run(tokens)


def text_of(decoded_tokens: Column) -> Column:
    """The text of decoded tokens."""
    return F.array_join(decoded_tokens, "")
