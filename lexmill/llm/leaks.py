"""Problem 9: passages of held-out evaluation items inside training text.

One Aho-Corasick automaton holds short seeds of all normalised passages (and, for the report, the whole normalised
questions, alone and with their answers), placed so densely that every run of the least length of a
passage contains a whole seed. A text is read and normalised once and scanned once; a hit is extended to both
sides in the normalised text and the item, and offsets are mapped back to the original text. Items of more than
ITEM_BLOCK_CHARS characters take several automata, one after the other over the texts a task holds.

Normal form: white space, punctuation, marks and other symbols dropped, letter case and full or half
width folded. Null and empty texts and items match nothing; items with the same passage are all given.
An answer counts where it stands after its question: alone, a short one such as a letter or a figure stands in texts
that never saw the item.
"""

from __future__ import annotations

import unicodedata
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.session import small_batches, spread

LEAST = 50
SEED = 25
#: Characters of the items one automaton holds, and of the texts a task holds while several automata go over them.
ITEM_BLOCK_CHARS = 2_000_000
HELD_TEXT_CHARS = 16_000_000


def fold(char: str) -> str:
    """The characters that stand for one character in the normal form: none, one or several."""
    wide = unicodedata.normalize("NFKC", char) if unicodedata.east_asian_width(char) in "FH" else char
    return "".join(c for c in wide.lower() if unicodedata.category(c)[0] in "LN")


class _Folds(dict):
    def __missing__(self, code: int) -> str:
        self[code] = value = fold(chr(code))
        return value


FOLDS = _Folds()


def normal(text: str | None) -> str:
    return (text or "").translate(FOLDS)


def offsets(text: str) -> list[int]:
    """For every character of the normal form the place of its original, and last the text's length."""
    out: list[int] = []
    for i, char in enumerate(text):
        out += [i] * len(FOLDS[ord(char)])
    return [*out, len(text)]


def seeds(passage: str, least: int = LEAST, seed: int = SEED) -> list[tuple[int, str]]:
    """(place, seed) so that every run of `least` characters of the passage holds a whole one."""
    if len(passage) < least:
        return []
    places = list(range(0, len(passage) - seed + 1, least - seed + 1))
    return [(p, passage[p : p + seed]) for p in places]


class Scanner:
    def __init__(self, items: list[tuple], least: int = LEAST, seed: int = SEED):
        """items: (id, part, normalised text, whole): whole texts must occur wholly, others in a run of `least`."""
        import ahocorasick

        self.items, self.least = items, least
        where: dict[str, list[tuple[int, int]]] = {}
        for n, (_, _, text, whole) in enumerate(items):
            for place, piece in [(0, text)] if whole and text else seeds(text, least, seed):
                where.setdefault(piece, []).append((n, place))
        self.automaton = ahocorasick.Automaton()
        for piece, at in where.items():
            self.automaton.add_word(piece, (len(piece), at))
        if where:
            self.automaton.make_automaton()
        self.any = bool(where)

    def scan(self, text: str | None) -> list[tuple]:
        """(item number, start, end) of maximal runs in the normal form of the text, each once."""
        return self.scan_normal(normal(text))

    def scan_normal(self, norm: str) -> list[tuple]:
        if not norm or not self.any:
            return []
        found: dict[tuple[int, int], tuple] = {}
        for end, (size, at) in self.automaton.iter(norm):
            for n, place in at:
                start = end + 1 - size
                if (old := found.get((n, start - place))) and old[1] <= start < old[2]:
                    continue
                item = self.items[n][2]
                lo, a, hi, b = start, place, end + 1, place + size
                while lo and a and norm[lo - 1] == item[a - 1]:
                    lo, a = lo - 1, a - 1
                while hi < len(norm) and b < len(item) and norm[hi] == item[b]:
                    hi, b = hi + 1, b + 1
                if self.items[n][3] or hi - lo >= self.least:
                    found[n, start - place] = (n, lo, hi)
                    found[n, start - place, lo] = (n, lo, hi)  # type: ignore[index]
        return sorted({x for x in found.values()})


def item_blocks(items: DataFrame, parts: dict[str, bool], key: str = "item_id", block_chars: int = ITEM_BLOCK_CHARS):
    """Lists of (id, part, normalised text, whole) of about `block_chars` characters; a part `a+b` is both columns' text, none if either is null."""
    names = sorted({c for part in parts for c in part.split("+")})
    block, size = [], 0
    for r in items.select(key, *names).distinct().orderBy(key, *names).toLocalIterator():
        for part, whole in parts.items():
            texts = [r[c] for c in part.split("+")]
            if all(texts) and (held := normal("".join(texts))):
                block.append((r[key], part, held, whole))
                size += len(held)
        if size > block_chars:
            yield block
            block, size = [], 0
    yield block


_BUILT: dict = {}


def _scanner(name, block, least) -> Scanner:
    """The automaton of a block, kept by the worker from task to task; only the last one is."""
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Scanner(block.value, least)
    return _BUILT[name]


def _held(batches, chars: int):
    """Batches in lists of about so many characters of text."""
    held, size = [], 0
    for batch in batches:
        texts = batch.column(1).to_pylist()
        held.append((batch, texts))
        size += sum(map(len, texts))
        if size >= chars:
            yield held
            held, size = [], 0
    if held:
        yield held


def leak_spans(documents: DataFrame, items: DataFrame, parts: dict[str, bool] | None = None, key: str = "doc_id", text: str = "text", item_key: str = "item_id", least: int = LEAST, block_chars: int = ITEM_BLOCK_CHARS) -> DataFrame:
    """(doc, item, part, start, end, run): each leaked run with its offsets in the original text and its length in the normal form.

    parts names the item columns (`a+b` for two in a row); the value says whether the part must occur wholly.
    """
    parts = parts or {"passage": False}
    small_batches(documents.sparkSession)
    context = documents.sparkSession.sparkContext
    run = uuid.uuid4().hex
    blocks = [(f"{run}-{i}", context.broadcast(block)) for i, block in enumerate(item_blocks(items, parts, item_key, block_chars))]
    kind, item_kind = documents.schema[key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    schema = f"doc {kind}, item {item_kind}, part string, start int, end int, run int"
    rows = spread(documents.where(F.length(text) >= (1 if any(parts.values()) else least)).select(F.col(key).alias("doc"), F.col(text).alias("t")))

    def scan(batches):
        import pyarrow as pa

        types = [pa.int64() if item_kind == "bigint" else pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
        for held in _held(batches, 1 if len(blocks) == 1 else HELD_TEXT_CHARS):
            norms = [[normal(t) for t in texts] for _, texts in held]
            back: dict = {}
            for name, block in blocks:
                scanner = _scanner(name, block, least)
                for b, (batch, texts) in enumerate(held):
                    out = []
                    for i, norm in enumerate(norms[b]):
                        if hits := scanner.scan_normal(norm):
                            if (b, i) not in back:
                                back[b, i] = offsets(texts[i])
                            to = back[b, i]
                            out += [(i, *scanner.items[n][:2], to[lo], to[hi - 1] + 1, hi - lo) for n, lo, hi in hits]
                    cols = list(zip(*out)) if out else [[]] * 6
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cols[0], pa.int64())), *(pa.array(c, t) for c, t in zip(cols[1:], types))], ["doc", "item", "part", "start", "end", "run"])

    return rows.mapInArrow(scan, schema)


def leaked_documents(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id): documents with at least LEAST consecutive normalised characters of the item's passage."""
    return leak_spans(documents, items).select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id")).distinct()


def leak_report(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, split, n_documents, longest_run, n_questions, n_answered): per held-out item how far it leaked; items that didn't have 0.

    n_questions counts documents with the whole question, of any length, n_answered those where the answer follows it.
    """
    spans = leak_spans(documents, items, {"passage": False, "question": True, "question+answer": True})
    docs = lambda part: F.countDistinct(F.when(F.col("part") == part, F.col("doc")))
    by = spans.groupBy(F.col("item").alias("item_id")).agg(
        docs("passage").alias("n_documents"), F.max(F.when(F.col("part") == "passage", F.col("run"))).alias("longest_run"),
        docs("question").alias("n_questions"), docs("question+answer").alias("n_answered"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return items.select("item_id", "split").distinct().join(by, "item_id", "left").select("item_id", "split", *(zero(c) for c in ("n_documents", "longest_run", "n_questions", "n_answered")))
