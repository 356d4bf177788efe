"""Co-citation graphs: pairs, degrees, PageRank, components, communities, missed neighbours."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.operators.pairs import BLOCK, pair_rows
from lexmill.session import stage


def pair_edges(items: DataFrame, group: str, item: str, least: int = 1, block: int = BLOCK) -> DataFrame:
    """(a, b, w), a < b: in how many groups both items occur, at least `least`.

    Groups of up to `block` different items make their pairs where their set is; the pairs of larger ones are spread
    over blocks of the group (`pair_rows`), so that no task holds one.
    """
    rows = items.where(F.col(group).isNotNull() & F.col(item).isNotNull()).select(F.col(group).alias("g"), F.col(item).alias("i")).distinct()
    sizes = rows.groupBy("g").count()
    small = rows
    over = (sizes.agg(F.max("count")).first()[0] or 0) > block
    if over:
        large = stage(sizes.where(F.col("count") > block).select("g"), "large")
        small = rows.join(large, "g", "left_anti")
    sets = small.groupBy("g").agg(F.array_sort(F.collect_list("i")).alias("s")).where("size(s) > 1")
    firsts = sets.select("s", F.posexplode("s").alias("p", "a"))
    pairs = firsts.select("a", F.explode(F.slice("s", F.col("p") + 2, F.size("s"))).alias("b"))
    if over:
        pairs = pairs.unionByName(pair_rows(rows.join(large, "g", "left_semi"), ["g"], "i", block).select(F.col("item_a").alias("a"), F.col("item_b").alias("b")))
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("w")).where(F.col("w") >= least)


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b", "w").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))


def weighted_degree(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("degree"), F.sum("w").alias("weight"))


def suggest_missed(edges: DataFrame, cited: DataFrame, top: int = 5, rank_by: str = "lift") -> DataFrame:
    """(query_id, article, score, co_count, anchor, rk): neighbours of a query's cited articles that it doesn't cite.

    lift: the sum of w / sqrt(weight(a) * weight(b)); count: the sum of w. anchor: the cited one with the
    heaviest edge, the least of equals. cited: query_id, article.
    """
    both = both_ways(edges)
    deg = weighted_degree(edges)
    wa, wb = deg.select(F.col("node").alias("a"), F.col("weight").alias("wa")), deg.select(F.col("node").alias("b"), F.col("weight").alias("wb"))
    strong = both.join(wa, "a").join(wb, "b").withColumn("part", F.col("w") / F.sqrt(F.col("wa").cast("double") * F.col("wb")) if rank_by == "lift" else F.col("w").cast("double"))
    # a number of parts is named, as few small rows fan out to all neighbours of their articles
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = cited.select("query_id", F.col("article").alias("a")).distinct().repartition(parts, "query_id")
    near = asked.join(strong, "a").join(asked.select("query_id", F.col("a").alias("b")), ["query_id", "b"], "left_anti")
    anchor = F.min(F.struct((-F.col("w")).alias("w"), "a"))
    scored = near.groupBy("query_id", F.col("b").alias("article")).agg(F.round(F.sum("part"), 6).alias("score"), F.sum("w").alias("co_count"), anchor.alias("best"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "article")
    return scored.select("query_id", "article", "score", "co_count", F.col("best.a").alias("anchor")).withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= top)


def pagerank(edges: DataFrame, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """(node, rank) after a fixed number of rounds on the undirected weighted graph; ranks start at 1/N."""
    both = stage(both_ways(edges), "edges")
    share = stage(both.join(both.groupBy("a").agg(F.sum("w").alias("t")), "a").select("a", "b", (F.col("w") / F.col("t")).alias("p")), "share")
    nodes = both.select(F.col("a").alias("node")).distinct()
    n = nodes.count()
    now = nodes.withColumn("rank", F.lit(1.0 / max(n, 1)))
    for i in range(rounds):
        given = share.join(now, share.a == now.node).groupBy(F.col("b").alias("node")).agg((F.lit((1 - damping) / max(n, 1)) + damping * F.sum(F.col("rank") * F.col("p"))).alias("rank"))
        now = stage(given, "rank") if i % 5 == 4 else given
    return now


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, component): component is the least node reached. Labels are passed to neighbours and jump to the label's label, until none changes."""
    both = stage(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    now = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    for _ in range(rounds):
        heard = both.join(now, both.b == now.node).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("heard"))
        told = now.join(heard, "node").select("node", "component", F.least("component", "heard").alias("new"))
        jump = now.select(F.col("node").alias("new"), F.col("component").alias("far"))
        new = stage(told.join(jump, "new", "left").select("node", "component", F.least("new", F.coalesce("far", "new")).alias("new")), "labels")
        changed = new.where("component <> new").limit(1).count()
        now = new.select("node", F.col("new").alias("component"))
        if not changed:
            return now
    raise RuntimeError(f"components didn't settle in {rounds} rounds")


#: Up to so many edges the community search runs in one task, beyond by joins: the same steps, hence the same communities.
COMMUNITY_EDGES = 200_000
#: Rounds without a better modularity after which a level of the community search ends.
PATIENCE = 12


def communities(edges: DataFrame, seed: int = 42) -> DataFrame:
    """(node, community) by Louvain's method with moves in rounds (`louvain`); community is its least node.

    Weights are taken to a millionth, so that all sums are exact and don't depend on their order.
    """
    edges = stage(edges.select("a", "b", F.round(F.col("w").cast("double") * 1_000_000).cast("decimal(18,0)").alias("w")), "graph")
    if edges.count() > COMMUNITY_EDGES:
        return _louvain_by_joins(edges, seed)
    kind = edges.schema["a"].dataType.simpleString()

    def search(frame):
        import pandas as pd

        found = _louvain([(a, b, int(w)) for a, b, w in zip(frame["a"], frame["b"], frame["w"])], seed)
        return pd.DataFrame({"node": list(found), "community": list(found.values())})

    return edges.withColumn("g", F.lit(0)).groupBy("g").applyInPandas(search, f"node {kind}, community {kind}")


def louvain(edges: list[tuple], seed: int = 42) -> dict:
    """Node -> least node of its community, by greedy modularity moves and aggregation until nothing gains.

    In a round a half of the nodes, drawn by hash, moves at once, each to the neighbouring community of the
    greatest gain. A level ends when no node would move or PATIENCE rounds brought no better modularity; its
    best round counts. Levels end when none is better than the one before.
    """
    return _louvain([(a, b, round(float(w) * 1_000_000)) for a, b, w in edges], seed)


def _louvain(edges: list[tuple], seed: int) -> dict:
    import hashlib
    from collections import defaultdict

    graph: dict = defaultdict(lambda: defaultdict(int))
    for a, b, w in edges:
        graph[a][b] += w
        graph[b][a] += w
    member, level = {x: x for x in graph}, 0
    total = sum(sum(v.values()) for v in graph.values())
    while True:
        degree = {i: sum(v.values()) for i, v in graph.items()}

        def score(home):
            inside, weight = sum(w for i, v in graph.items() for j, w in v.items() if home[i] == home[j]), defaultdict(int)
            for i, c in home.items():
                weight[c] += degree[i]
            return inside * total - sum(x * x for x in weight.values()), weight

        home, turn, last = {i: i for i in graph}, 0, 0
        start, weight = score(home)
        best, best_home = start, home
        while turn - last < PATIENCE:
            wish = {}
            for i, v in graph.items():
                links: dict = defaultdict(int, {home[i]: 0})
                for j, w in v.items():
                    if j != i:
                        links[home[j]] += w
                wish[i] = min(links, key=lambda c: (-(links[c] * total - degree[i] * (weight[c] - (degree[i] if c == home[i] else 0))), c != home[i], c))
            if wish == home:
                break
            home = {i: c if hashlib.md5(f"{seed} {level} {turn} {i}".encode()).hexdigest() >= "8" else home[i] for i, c in wish.items()}
            turn += 1
            now, weight = score(home)
            if now > best:
                best, best_home, last = now, home, turn
        if best <= start:
            break
        member = {x: best_home[c] for x, c in member.items()}
        new: dict = defaultdict(lambda: defaultdict(int))
        for i, v in graph.items():
            for j, w in v.items():
                new[best_home[i]][best_home[j]] += w
        graph, level = new, level + 1
    least: dict = {}
    for x in sorted(member):
        least.setdefault(member[x], x)
    return {x: least[c] for x, c in sorted(member.items())}


def _louvain_by_joins(edges: DataFrame, seed: int) -> DataFrame:
    """The steps of `_louvain` on tables."""
    exact = lambda c: c.cast("decimal(18,0)")
    square = "decimal(38,0)"
    graph = stage(both_ways(edges).groupBy("a", "b").agg(exact(F.sum("w")).alias("w")), "level")
    member = graph.select(F.col("a").alias("node"), F.col("a").alias("c")).distinct()
    total, level = F.lit(graph.agg(F.sum("w")).first()[0]).cast("decimal(18,0)"), 0
    while True:
        nodes = stage(graph.groupBy(F.col("a").alias("i")).agg(exact(F.sum("w")).alias("k")), "nodes")

        def placed(home):
            """Score of the nodes' communities (i, k, c), and the communities' weights."""
            weight = home.groupBy("c").agg(exact(F.sum("k")).alias("weight"))
            ends = graph.join(home.select(F.col("i").alias("a"), F.col("c").alias("ca")), "a").join(home.select(F.col("i").alias("b"), F.col("c").alias("cb")), "b")
            inside = ends.where("ca = cb").agg(F.coalesce(exact(F.sum("w")), F.lit(0).cast("decimal(18,0)")).alias("x"))
            squares = weight.agg(F.sum((F.col("weight") * F.col("weight")).cast(square)).cast(square).alias("y"))
            return inside.crossJoin(squares).select((F.col("x") * total).cast(square) - F.col("y")).first()[0], weight

        home, turn, last = nodes.withColumn("c", F.col("i")), 0, 0
        start, weight = placed(home)
        best, best_home = start, home
        while turn - last < PATIENCE:
            near = graph.where("a <> b").join(home.select(F.col("i").alias("b"), "c"), "b").select(F.col("a").alias("i"), "c", "w")
            links = near.unionByName(home.select("i", "c", F.lit(0).cast("decimal(18,0)").alias("w"))).groupBy("i", "c").agg(exact(F.sum("w")).alias("w"))
            able = links.join(home.select("i", "k", F.col("c").alias("own")), "i").join(weight, "c").withColumn("other", F.col("c") != F.col("own"))
            rest = F.when(F.col("other"), F.col("weight")).otherwise(exact(F.col("weight") - F.col("k")))
            gain = (F.col("w") * total).cast(square) - (F.col("k") * rest).cast(square)
            wish = able.groupBy("i", "k", "own").agg(F.min(F.struct((-gain).alias("loss"), "other", "c")).alias("v"))
            draw = F.md5(F.concat(F.lit(f"{seed} {level} {turn} "), F.col("i").cast("string"))) >= "8"
            moved = stage(wish.select("i", "k", F.when(draw, F.col("v.c")).otherwise(F.col("own")).alias("c"), F.col("v.other").alias("would")), "home")
            if not moved.where("would").limit(1).count():
                break
            home, turn = moved.select("i", "k", "c"), turn + 1
            now, weight = placed(home)
            if now > best:
                best, best_home, last = now, home, turn
        if best <= start:
            break
        to = best_home.select("i", F.col("c").alias("to"))
        member = stage(member.join(to, member.c == to.i).select("node", F.col("to").alias("c")), "member")
        ends = graph.join(to.select(F.col("i").alias("a"), F.col("to").alias("x")), "a").join(to.select(F.col("i").alias("b"), F.col("to").alias("y")), "b")
        graph, level = stage(ends.groupBy(F.col("x").alias("a"), F.col("y").alias("b")).agg(exact(F.sum("w")).alias("w")), "level"), level + 1
    least = member.groupBy("c").agg(F.min("node").alias("community"))
    return member.join(least, "c").select("node", "community")
