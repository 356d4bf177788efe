"""Problem 5: oversized texts cut at natural boundaries, with an overlap.

Recursive separator hierarchy: blank line (section), line break (paragraph), sentence end, white space
(word), character. A part within the limit stays whole; a larger one is split by the next finer
separator. The parts are packed greedily: each piece takes as many as fit, and every piece after the
first begins with the last `overlap` characters of the piece before it, so the pieces without their
overlaps joined are the text.

Texts within the limit, empty and null texts aren't oversized and give no pieces. Lengths are code points.
"""

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.session import small_batches

LIMIT = 800
OVERLAP = 80

# Natural boundaries: these marks, a line break, and a full stop before white space or the end.
_LINE = "\n\r"
_SENTENCE = rf"[。！？；!?;]|\.(?=\s|$)"
_BOUNDARY = re.compile(rf"{_SENTENCE}|[{_LINE}]")
_LEVELS = [re.compile(p) for p in (rf"(?:[^\S{_LINE}]*[{_LINE}]){{2,}}", rf"[{_LINE}]+", rf"(?:{_SENTENCE})+", r"\s+")]


def _split(text: str, start: int, end: int, level: int, limit: int, out: list[int]) -> None:
    """Appends the ends of the parts of text[start:end], none larger than the limit."""
    if end - start <= limit:
        out.append(end)
        return
    if level == len(_LEVELS):
        out.extend(range(start + limit, end, limit))
        out.append(end)
        return
    ends = [m.end() for m in _LEVELS[level].finditer(text, start, end)]
    at = start
    for e in [*ends, end]:
        if e > at:
            _split(text, at, e, level + 1, limit, out)
            at = e


def pieces(text: str | None, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of the pieces of an oversized text; none for others. A piece after the first starts `overlap` before the end of the last."""
    if not text or len(text) <= limit:
        return []
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    out: list[tuple[int, int]] = []
    start = cut = 0  # of the piece; and where its new text begins
    ends: list[int] = []
    _split(text, 0, len(text), 0, limit, ends)
    i, last = 0, 0
    while i < len(ends):
        if ends[i] - start <= limit:
            last = ends[i]
            i += 1
            continue
        if last > cut:
            out.append((start, last))
            start, cut = max(0, last - overlap), last
            continue
        # one part doesn't fit behind the overlap: cut it by finer separators to the room there is
        finer: list[int] = []
        _split(text, cut, ends[i], 0, start + limit - cut, finer)
        ends[i : i + 1] = finer
    if last > cut:
        out.append((start, last))
    return out


def longest_stretch(text: str) -> int:
    """The most consecutive characters without a natural boundary."""
    most = at = 0
    for match in _BOUNDARY.finditer(text):
        most, at = max(most, match.start() - at), match.end()
    return max(most, len(text) - at)


def cut_pieces(chunks: DataFrame, key: str = "chunk_id", text: str = "content", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(key, piece_no, n_pieces, start, end, piece, cut_kind) of every distinct oversized text of a key.

    cut_kind is `hard` if the text has a stretch of more than `limit` characters without a natural
    boundary, else `boundary`. Only oversized texts leave the JVM; rows are independent, nothing is shuffled.
    """
    small_batches(chunks.sparkSession)
    kind = chunks.schema[key].dataType.simpleString()

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            at, rows = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                hard = "hard" if longest_stretch(t) > limit else "boundary"
                spans = pieces(t, limit, overlap)
                at += [i] * len(spans)
                rows += [(n, len(spans), a, b, t[a:b], hard) for n, (a, b) in enumerate(spans)]
            cols = list(zip(*rows)) if rows else [[]] * 6
            kinds = [pa.int32()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["k", "piece_no", "n_pieces", "start", "end", "piece", "cut_kind"])

    long = chunks.where(F.length(text) > limit).select(F.col(key).alias("k"), F.col(text).alias("t"))
    out = long.mapInArrow(cut, f"k {kind}, piece_no int, n_pieces int, start int, end int, piece string, cut_kind string")
    return out.withColumnRenamed("k", key)


def oversized(chunks: DataFrame) -> DataFrame:
    """(chunk_id, cut_kind) of each oversized chunk; `hard` if any of its stored texts needs a hard cut."""
    cut = cut_pieces(chunks).where("piece_no = 0")
    return cut.groupBy("chunk_id").agg(F.max("cut_kind").alias("cut_kind"))  # "hard" > "boundary"
