"""Problem 10: long exact spans that several records share.

Texts are cut into tokens whose borders depend on the characters around them only: of every WINDOW starts the
one whose run of GRAM characters has the least hash is a border (winnowing), and a token reaches from a border to
the next. The de Bruijn graph has the tokens as nodes and the k-mers of two tokens as edges, so
a run of LEAST characters holds three borders at the same places in each of its texts: at least one common edge.

Edges that occur in one text only are dropped. An edge that always follows the same edge, and as
often as that one occurs, lies inside a nonbranching path; such links are followed by pointer doubling, a join a
round, until every edge knows the head of its path. A path is one row with its edges, its characters
and its visits; whoever holds one of its edges holds all of it.

Source coordinates verify long spans: the visits of a path of LEAST characters or more are compared
in their texts. A shorter path is extended by what stands around each visit: runs of LEAST characters that hold
the path are fingerprinted, equal ones are grouped, groups of the same visits are taken once, and the characters
of their members are compared.

Texts that are null, empty or shorter than the least length share nothing. Exact copies are first
collapsed to one representative and expanded at the end.
"""

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.operators.keyfilter import key_filter, test_held
from lexmill.operators.pairs import pairs_in_groups
from lexmill.session import small_batches, spread, stage

LEAST = 160
SEGMENT = 1 << 20


def sizes(least: int) -> tuple[int, int]:
    """(GRAM, WINDOW): three windows and a run of GRAM - 1 characters fit into a span of the least length."""
    gram = 2 * least // 5
    return gram, (least - gram + 1) // 3


_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_LOW = np.uint64((1 << 24) - 1)
_TABLES: dict = {}


def _tables(n: int):
    """Random words by code point and powers of the base and its inverse, for texts of up to n characters."""
    if _TABLES.get("n", 0) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        _TABLES["n"] = size
        _TABLES["char"] = np.random.default_rng(160).integers(0, 1 << 64, 0x110000, dtype=np.uint64)
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            powers = np.full(size, np.uint64(base))
            powers[0] = 1
            _TABLES[name] = np.cumprod(powers)
    return _TABLES["char"], _TABLES["up"], _TABLES["down"]


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)


def _sums(chars: np.ndarray) -> np.ndarray:
    table, up, _ = _tables(len(chars) + 1)
    sums = np.zeros(len(chars) + 1, np.uint64)
    np.cumsum(table[chars] * up[: len(chars)], out=sums[1:])
    return sums


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def window_hashes(chars: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every run of `size` characters, equal for equal runs wherever they are."""
    sums, down = _sums(chars), _tables(len(chars) + 1)[2]
    return _mixed((sums[size:] - sums[:-size]) * down[: len(chars) - size + 1])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` consecutive values, by block-wise prefix and suffix minima."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def token_edges(texts: list[str], least: int = LEAST):
    """(index of text, position, length, gap, hash) of every edge of all texts, in order.

    An edge is two consecutive tokens and the gram at its last border; gap is the length of the token before it, 0 for
    the first edge of a text. Very long texts are cut into segments that overlap by more than an edge and a window.
    """
    gram, window = sizes(least)
    span, lap = gram + window - 1, 4 * (gram + 3 * window)
    parts = []
    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - lap), SEGMENT):
            part = text[at : at + SEGMENT + lap]
            if len(part) >= span:
                parts.append((i, at, part))
    none = np.zeros(0, np.int64)
    if not parts:
        return none, none, none, none, np.zeros(0, np.uint64)
    lengths = np.array([len(p[2]) for p in parts], np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    chars = codes("".join(p[2] for p in parts))
    sums, down = _sums(chars), _tables(len(chars) + 1)[2]
    h = _mixed((sums[gram:] - sums[:-gram]) * down[: len(chars) - gram + 1])
    part = np.repeat(np.arange(len(parts)), lengths)[: len(h)]
    within = np.arange(len(h)) - starts[part]
    packed = (h & ~_LOW) | within.astype(np.uint64)
    packed[within > lengths[part] - gram] = np.iinfo(np.uint64).max
    least_of = sliding_min(packed, window)
    n = len(least_of)
    good = within[:n] <= lengths[part[:n]] - span
    borders = starts[part[:n][good]] + (least_of[good] & _LOW).astype(np.int64)
    borders = borders[np.concatenate([[True], borders[1:] != borders[:-1]])] if len(borders) else borders
    if len(borders) < 3:
        return none, none, none, none, np.zeros(0, np.uint64)
    first, last, owner = borders[:-2], borders[2:], part[borders]
    one = owner[:-2] == owner[2:]
    before = np.concatenate([[0], np.where(owner[1:] == owner[:-1], np.diff(borders), 0)])[:-2][one]
    first, middle, last, owner = first[one], borders[1:-1][one], last[one], owner[:-2][one]
    length = last + gram - first
    # the borders belong to the edge: its first token's length goes into the hash
    edge = _mixed(_mixed((sums[last + gram] - sums[first]) * down[first]) + (middle - first).astype(np.uint64) * np.uint64(_BASE) + length.astype(np.uint64))
    text_of, base = np.array([p[0] for p in parts], np.int64)[owner], np.array([p[1] for p in parts], np.int64)[owner]
    at = base + first - starts[owner]
    # an edge in the overlap of two segments is given twice; the one that knows the token before it stays
    order = np.lexsort((-before, at, text_of))
    fresh = order[np.concatenate([[True], (text_of[order][1:] != text_of[order][:-1]) | (at[order][1:] != at[order][:-1])])]
    return text_of[fresh], at[fresh], length[fresh], before[fresh], edge[fresh]


def _long(documents: DataFrame, key: str, text: str, least: int) -> DataFrame:
    return documents.where((F.length(text) >= least) & F.col(key).isNotNull()).select(F.col(key).alias("doc"), F.col(text).alias("t"))


def repeated_edges(rows: DataFrame, extra: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc, pos, len, gap, h): the edges of rows (doc, t) that occur in two different texts; documents of `extra` are left out.

    The first pass shuffles only hashes (texts are told apart by their own hash, so copies don't count); the
    second one drops edges by a filter of the repeated ones where they are made and joins what is left.
    """
    small_batches(rows.sparkSession)
    kind = rows.schema["doc"].dataType.simpleString()

    def hashes(batches):
        import pyarrow as pa

        for batch in batches:
            owner, _, _, _, h = token_edges(batch.column(1).to_pylist(), least)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), batch.column(0).take(pa.array(owner))], ["h", "digest"])

    seen = rows.select(F.xxhash64("t").alias("digest"), "t").mapInArrow(hashes, "h bigint, digest bigint")
    twice = stage(seen.groupBy("h").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo < hi").select("h"), "twice")
    filtered = key_filter(twice, ready=True)
    held = rows.sparkSession.sparkContext.broadcast(filtered.held) if filtered.held is not None else None

    def places(batches):
        import pyarrow as pa

        for batch in batches:
            owner, at, length, gap, h = token_edges(batch.column(1).to_pylist(), least)
            if held is not None:
                may = test_held(held.value, h.view(np.int64))
                owner, at, length, gap, h = (x[may] for x in (owner, at, length, gap, h))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), *(pa.array(x.astype(np.int32)) for x in (at, length, gap)), pa.array(h.view(np.int64))], ["doc", "pos", "len", "gap", "h"])

    found = rows.mapInArrow(places, f"doc {kind}, pos int, len int, gap int, h bigint")
    return found.join(twice, "h").join(extra, "doc", "left_anti").select("doc", "pos", "len", "gap", "h")


def edge_links(repeated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((h, len, n) of every edge, (h, to, off) of those inside a nonbranching path: the edge before and how far back it begins)."""
    row = Window.partitionBy("doc").orderBy("pos")  # one text's own edges
    with_prev = repeated.withColumn("prev", F.when((F.col("gap") > 0) & (F.lag("pos").over(row) == F.col("pos") - F.col("gap")), F.lag("h").over(row)))
    by = stage(with_prev.groupBy("h").agg(F.first("len").alias("len"), F.count(F.lit(1)).alias("n"), F.count("prev").alias("np"), F.min("prev").alias("p0"), F.max("prev").alias("p1"), F.min("gap").alias("g0"), F.max("gap").alias("g1")), "edges")
    before = by.select(F.col("h").alias("p0"), F.col("n").alias("n_before"))
    links = by.where("np = n and p0 = p1 and g0 = g1 and p0 <> h").join(before, "p0").where("n_before = n").select("h", F.col("p0").alias("to"), F.col("g0").cast("bigint").alias("off"))
    return by.select("h", "len", "n"), links


def _doubled(links: DataFrame) -> DataFrame:
    """Every link followed by the link of the edge it leads to, if that has one."""
    ahead = links.select(F.col("h").alias("to"), F.col("to").alias("far"), F.col("off").alias("more"))
    joined = links.join(ahead, "to", "left")
    return joined.select("h", F.coalesce("far", "to").alias("to"), (F.col("off") + F.coalesce("more", F.lit(0))).alias("off"), (F.col("moved") | F.col("far").isNotNull()).alias("moved"))


def compacted(edges: DataFrame, links: DataFrame) -> DataFrame:
    """(path, chars, n_edges, n_visits, last_len): nonbranching paths, named by the hash of their first edge.

    Links are doubled by joins, twice a round: afterwards each edge points to the head of its path. Links can't form a
    circle, as the first edge of a text has none before it, so the rounds end after the logarithm of the longest path.
    """
    links = stage(links, "links")
    while True:
        # two joins a round: each link is followed to four times its length
        longer = stage(_doubled(_doubled(links.withColumn("moved", F.lit(False)))), "links")
        moved = not longer.where("moved").isEmpty()
        links = longer.drop("moved")
        if not moved:
            break
    placed = edges.join(links, "h", "left").select(F.coalesce("to", "h").alias("path"), F.coalesce("off", F.lit(0)).alias("off"), "len", "n")
    return placed.groupBy("path").agg(F.max(F.col("off") + F.col("len")).alias("chars"), F.count(F.lit(1)).alias("n_edges"), F.first("n").alias("n_visits"), F.max_by("len", "off").alias("last_len"), F.min_by("len", "off").alias("first_len"))


def copy_classes(documents: DataFrame, key: str, text: str, least: int) -> DataFrame:
    """(doc, rep): members of classes of identical texts with at least two rows; rep is the least key."""
    marked = _long(documents, key, text, least).select("doc", F.unhex(F.md5("t")).alias("digest"))
    classes = marked.groupBy("digest").agg(F.min("doc").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return marked.join(classes, "digest").select("doc", "rep")


class SpanGraph:
    """The staged tables of one run: copies, visits of the compacted paths, and the texts that hold any."""

    def __init__(self, documents: DataFrame, key: str, text: str, least: int):
        self.least = least
        self.rows = spread(_long(documents, key, text, least))
        self.copies = stage(copy_classes(documents, key, text, least), "copies")
        repeated = stage(repeated_edges(self.rows, self.copies.where("doc <> rep").select("doc"), least), "repeated")
        edges, links = edge_links(repeated)
        self.paths = stage(compacted(edges, links), "paths")
        self.visits = stage(repeated.select(F.col("h").alias("path"), "doc", "pos").join(self.paths, "path"), "visits")
        docs = self.visits.select("doc").distinct()
        self.texts = stage(_pruned(self.rows, docs), "texts")


def _pruned(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows of the documents; most others are dropped by a filter before the join."""
    held = key_filter(docs.select(F.xxhash64("doc")))
    return held.mark(rows, F.xxhash64("doc"), "_may").where("_may").drop("_may").join(docs, "doc", "left_semi")


def run_prints(texts: DataFrame, visits: DataFrame, least: int, ends: bool) -> DataFrame:
    """(path, off, fp, doc, pos, at): runs of the least length around the visits; off is the visit's place in the run.

    Those that hold a path shorter than them or, with `ends`, those that hold the first or last edge of any path without lying inside it.
    """
    kind = texts.schema["doc"].dataType.simpleString()
    of = visits.groupBy("doc").agg(F.collect_list(F.struct("path", "pos", "chars", "first_len", "last_len")).alias("at"))  # of one text
    low = (lambda chars, first: first) if ends else (lambda chars, first: chars)

    def prints(batches):
        import pyarrow as pa

        for batch in batches:
            out = [[], [], [], [], [], []]
            for i, (t, places) in enumerate(zip(batch.column("t").to_pylist(), batch.column("at").to_pylist())):
                chars, cache = codes(t), {}
                for v in places:
                    p, n = v["pos"], v["chars"]
                    begun = [(p + low(n, v["first_len"]) - least, p)] + ([(p + n - least, p + n - v["last_len"])] if ends else [])
                    starts = np.unique(np.concatenate([np.arange(max(0, lo), min(hi, len(t) - least) + 1) for lo, hi in begun]))
                    if n >= least:
                        starts = starts[(starts < p) | (starts > p + n - least)]
                    if not len(starts):
                        continue
                    lo, hi = int(starts[0]), int(starts[-1])
                    if (lo, hi) not in cache:
                        cache[lo, hi] = window_hashes(chars[lo : hi + least], least)
                    for column, value in zip(out, (np.full(len(starts), v["path"]), p - starts, cache[lo, hi][starts - lo].view(np.int64), np.full(len(starts), i), starts, np.full(len(starts), p))):
                        column.append(value)
            path, off, fp, doc, pos, at = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)
            yield pa.RecordBatch.from_arrays([pa.array(path), pa.array(off.astype(np.int32)), pa.array(fp), batch.column("doc").take(pa.array(doc)), pa.array(pos.astype(np.int32)), pa.array(at.astype(np.int32))], ["path", "off", "fp", "doc", "pos", "at"])

    return texts.join(of, "doc").select("doc", "t", "at").mapInArrow(prints, f"path bigint, off int, fp bigint, doc {kind}, pos int, at int")


def sharing_classes(graph: SpanGraph) -> DataFrame:
    """(path, off, fp, run, doc): documents that hold an identical run of the least length form a class; characters are compared.

    `run` is '' for the members equal to the class's first document, else (two runs of one fingerprint) the run itself.
    """
    least = graph.least
    short = graph.visits.where(F.col("chars") < least)
    prints = stage(run_prints(graph.texts, short, least, ends=False), "prints")
    groups = prints.groupBy("path", "off", "fp").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("doc", "at")).alias("who"), F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi")
    # the runs around a path often have the same visits: one of them stands for all
    kept = groups.groupBy("path", "n", "who").agg(F.min(F.struct("off", "fp")).alias("r")).select("path", "r.off", "r.fp")
    around = prints.join(kept, ["path", "off", "fp"]).select("path", "off", "fp", "doc", "pos")
    whole = graph.visits.where(F.col("chars") >= least).select("path", F.lit(0).alias("off"), F.lit(0).cast("bigint").alias("fp"), "doc", "pos")
    keys = ["path", "off", "fp"]
    members = around.unionByName(whole).groupBy(*keys, "doc").agg(F.min("pos").alias("pos"))
    cut = F.substring("t", F.col("pos") + 1, F.lit(least))
    runs = stage(members.join(graph.texts, "doc").select(*keys, "doc", cut.alias("run")), "runs")
    first = runs.groupBy(*keys).agg(F.min("doc").alias("doc")).join(runs, [*keys, "doc"]).select(*keys, F.col("run").alias("first"))
    return runs.join(first, keys).select(*keys, F.when(F.col("run") == F.col("first"), "").otherwise(F.col("run")).alias("run"), "doc")


def representative_pairs(graph: SpanGraph) -> DataFrame:
    """(item_a, item_b): representatives that share a run of the least length."""
    return pairs_in_groups(sharing_classes(graph), ["path", "off", "fp", "run"], "doc")


def shared_span_pairs(documents: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """(doc_id_a, doc_id_b), a < b: records whose texts hold an identical run of at least `least` characters."""
    graph = SpanGraph(documents, key, text, least)
    sure, copies = representative_pairs(graph), graph.copies
    of_a, of_b = copies.select(F.col("rep").alias("item_a"), F.col("doc").alias("doc_a")), copies.select(F.col("rep").alias("item_b"), F.col("doc").alias("doc_b"))
    across = sure.join(of_a, "item_a", "left").join(of_b, "item_b", "left").select(F.coalesce("doc_a", "item_a").alias("x"), F.coalesce("doc_b", "item_b").alias("y"))
    across = across.select(F.least("x", "y").alias("item_a"), F.greatest("x", "y").alias("item_b"))
    return across.union(pairs_in_groups(copies, ["rep"], "doc")).select(F.col("item_a").alias("doc_id_a"), F.col("item_b").alias("doc_id_b"))


def shared_classes(documents: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """(key, class_id, n_copies, n_links) of every row: its class of exact copies (the least key) and with how many other classes that class shares a run.

    Copies are not expanded into pairs. A row whose text is null, empty or too short is its own class.
    """
    graph = SpanGraph(documents, key, text, least)
    pairs = representative_pairs(graph)
    links = pairs.select(F.col("item_a").alias("class_id")).unionAll(pairs.select("item_b")).groupBy("class_id").agg(F.count(F.lit(1)).alias("n_links"))
    sizes_of = graph.copies.groupBy("rep").agg(F.count(F.lit(1)).alias("n_copies")).withColumnRenamed("rep", "class_id")
    rows = documents.select(key).distinct().join(graph.copies.withColumnRenamed("doc", key), key, "left").select(key, F.coalesce("rep", key).alias("class_id"))
    return rows.join(sizes_of, "class_id", "left").join(links, "class_id", "left").select(key, "class_id", F.coalesce("n_copies", F.lit(1)).alias("n_copies"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def shared_paths(documents: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """(n_edges, chars, n_visits, n_paths): the nonbranching paths of the graph by their size."""
    paths = SpanGraph(documents, key, text, least).paths
    return paths.groupBy("n_edges", "chars", "n_visits").agg(F.count(F.lit(1)).alias("n_paths"))


def shared_share(documents: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """(key, n_chars, shared_chars, shared_share) of every row: how much of it occurs in runs of the least length elsewhere.

    Paths of the least length and the runs around path ends give intervals with a witness in another text; an interval
    counts if its characters are those of its witness. Null and empty texts have 0 characters; their share is 0.
    """
    graph = SpanGraph(documents, key, text, least)
    place = F.struct("doc", "pos")

    def witnessed(rows, keys, length):
        """(doc, pos, len, w_doc, w_pos): each place with one of the same key in another document."""
        ends = rows.groupBy(*keys).agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo.doc < hi.doc")
        other = F.when(F.col("doc") == F.col("lo.doc"), F.col("hi")).otherwise(F.col("lo"))
        return rows.join(ends, keys).select("doc", "pos", length.alias("len"), other["doc"].alias("w_doc"), other["pos"].alias("w_pos"))

    whole = witnessed(graph.visits.where(F.col("chars") >= least), ["path"], F.col("chars").cast("int"))
    prints = run_prints(graph.texts, graph.visits, least, ends=True).select("fp", "doc", "pos").distinct()
    runs = witnessed(stage(prints, "prints"), ["fp"], F.lit(least))
    # runs one after the other with the same witness at the same distance are one interval
    line = Window.partitionBy("doc", "w_doc", "diagonal").orderBy("pos")
    runs = runs.withColumn("diagonal", F.col("w_pos") - F.col("pos")).withColumn("island", F.col("pos") - F.row_number().over(line))
    joined = runs.groupBy("doc", "w_doc", "diagonal", "island").agg(F.min("pos").alias("pos"), F.max("pos").alias("to"))
    joined = joined.select("doc", "pos", (F.col("to") - F.col("pos") + least).alias("len"), "w_doc", (F.col("pos") + F.col("diagonal")).alias("w_pos"))
    part = lambda t, at: F.substring(t, F.col(at) + 1, F.col("len"))
    own = whole.unionByName(joined).join(graph.texts, "doc").withColumn("run", part("t", "pos")).drop("t")
    sure = own.join(graph.texts.select(F.col("doc").alias("w_doc"), F.col("t").alias("w")), "w_doc").where(F.col("run") == part("w", "w_pos")).select("doc", "pos", (F.col("pos") + F.col("len")).alias("end"))
    before = Window.partitionBy("doc").orderBy("pos", "end").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("pos"), F.coalesce(F.max("end").over(before), F.lit(0))))
    covered = sure.withColumn("fresh", fresh).groupBy("doc").agg(F.sum("fresh").alias("shared"))
    out = documents.select(F.col(key), F.coalesce(F.length(text), F.lit(0)).alias("n_chars")).join(graph.copies.withColumnRenamed("doc", key), key, "left")
    out = out.join(covered.withColumnRenamed("doc", key), key, "left")
    shared = F.when(F.col("rep").isNotNull(), F.col("n_chars")).otherwise(F.coalesce("shared", F.lit(0))).cast("bigint")
    return out.select(key, F.col("n_chars").cast("bigint").alias("n_chars"), shared.alias("shared_chars"), F.when(F.col("n_chars") > 0, F.round(shared / F.col("n_chars"), 4)).otherwise(F.lit(0.0)).alias("shared_share"))
