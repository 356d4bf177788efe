"""Problem 8: token ids of whole texts in a public byte-level vocabulary.

Texts go through the tiktoken library with a local rank file. A text is first cut at places where
the splitting pattern of the vocabulary can hold no token across the cut, so the ids of the pieces
joined are the ids of the text, whatever its length. Null and empty text both give an empty list.
"""

from __future__ import annotations

import array
import base64
import functools
import os
import re
from collections.abc import Iterator

from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.session import small_batches, spread

VOCABULARY_DIR = os.environ.get("LEXMILL_TOKENIZERS", "/opt/tokenizers")

#: Fixed value: the published splitting pattern of the byte-level vocabulary of 50k entries.
BYTE_BPE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

PIECE_CHARS = 1 << 15
RUN_CHARS = 256

# White space as the pattern's \s has it (Unicode White_Space), which differs from Python's \s.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LONG_RUN = re.compile(f"[{_SPACE}]{{{RUN_CHARS},}}")
# A token never goes on from a character that is no white space to one that is.
_SAFE = re.compile(f"(?<=[^{_SPACE}])(?=[{_SPACE}])")


@functools.cache
def encoding(path: str):
    """The tiktoken encoding of a rank file; one per worker process."""
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}
    return tiktoken.Encoding("local", pat_str=BYTE_BPE_PATTERN, mergeable_ranks=ranks, special_tokens={})


def _letters_end(text: str, start: int, stop: int) -> int:
    """The last place in (start, stop] after a letter and before a mark, else stop's nearest change of class, else -1.

    Pattern classes (letters; numbers; the rest) never share a token except for one leading space
    and a contraction, both of which begin with a character of the rest.
    """
    for at in range(min(stop, len(text) - 1), start, -1):
        if text[at - 1].isalpha() and not text[at].isalnum() and not text[at].isspace() and ord(text[at]) < 0x3100:
            return at
    return -1


def safe_pieces(text: str, size: int = PIECE_CHARS) -> Iterator[tuple[str, bool]]:
    """(piece, single) in order; a piece marked single is one match of the pattern by itself.

    A run of at least RUN_CHARS white space is one match without its last character when something
    follows it, and wholly when it ends the text. A run of letters longer than `size` is kept whole.
    """
    at = 0
    for run in _LONG_RUN.finditer(text):
        yield from ((piece, False) for piece in _cut(text[at : run.start()], size))
        end = run.end() if run.end() == len(text) else run.end() - 1
        yield text[run.start() : end], True
        at = end
    yield from ((piece, False) for piece in _cut(text[at:], size))


def _cut(text: str, size: int) -> Iterator[str]:
    at = 0
    while len(text) - at > size:
        end = -1
        for match in _SAFE.finditer(text, at + size // 2, min(at + size + 1, len(text))):
            end = match.start()
        if end <= at:
            end = _letters_end(text, at + size // 2, at + size)
        if end <= at:
            found = _SAFE.search(text, at + size)
            end = found.start() if found else len(text)
        yield text[at:end]
        at = end
    if at < len(text):
        yield text[at:]


def encode_text(text: str | None, enc) -> list[int]:
    if not text:
        return []
    if len(text) <= RUN_CHARS:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for piece, single in safe_pieces(text):
        ids += enc._core_bpe.encode_single_piece(piece.encode()) if single else enc.encode_ordinary(piece)
    return ids


def decode_ids(ids, enc) -> str:
    """The text of the ids, through raw bytes: one character may lie in several tokens."""
    return b"".join(enc.decode_single_token_bytes(i) for i in ids).decode()


def token_ids(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = f"{VOCABULARY_DIR}/byte_bpe_50k.tiktoken") -> DataFrame:
    """(key, ids) of every row; null and empty texts give []. Other columns are not read.

    A narrow map without shuffle: every Arrow batch is encoded where it is read. The vocabulary is shipped with
    the job, so that an executor needn't have it.
    """
    small_batches(documents.sparkSession)
    if os.path.exists(vocabulary):
        documents.sparkSession.sparkContext.addFile(vocabulary)
    kind = documents.schema[key].dataType.simpleString()

    def encode(batches):
        import pyarrow as pa

        enc = encoding(vocabulary if os.path.exists(vocabulary) else SparkFiles.get(os.path.basename(vocabulary)))
        for batch in batches:
            flat, offsets = array.array("i"), array.array("i", [0])
            for value in batch.column(1):
                flat.extend(encode_text(value.as_py(), enc))
                offsets.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.Array.from_buffers(pa.int32(), len(offsets), [None, pa.py_buffer(offsets)]), pa.Array.from_buffers(pa.int32(), len(flat), [None, pa.py_buffer(flat)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["k", "ids"])

    rows = documents.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return spread(rows).mapInArrow(encode, f"k {kind}, ids array<int>").withColumnRenamed("k", key)
