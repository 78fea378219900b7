"""N-gram Jaccard join: documents whose shingle sets are similar enough, found by token-combination prefixes.

A token is a shingle. All tokens are put in one order: rare ones first, frequent ones last, each class by hash. Two sets
with Jaccard of at least ``percent`` share a token among the first ``n - ceil(percent * n) + 1`` tokens of both. If the
first token they share is rare, the single-token index finds them. If it is frequent, a frequent token stands in the
prefix of both; for such sets the prefix is extended to the whole set and combinations of about five tokens are indexed:
tokens are dealt by hash around a ring of so many parts that two similar sets must agree in two neighbouring parts,
and the tokens of two neighbouring parts are one key. Sets are compared within classes of sizes, each with its number of
parts. Candidates are verified on whole sets.

The class of a token comes from a count sketch over all documents: its size is a parameter and its result one bit a
counter, so it costs the same at every scale; any classes give right results, they only set the cost.

Work on groups: equal sets are one node, so a group of copies is compared once. Every index list is first compared with
its smallest node only. Lists that then still hold several components are compared across components: short lists of
rare tokens as pairs, nodes connected by combinations in blocks, where each task compares two blocks of bounded size and
returns a spanning part of the links it found. Links are counted last, over all pairs of each component, in blocks too.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import global_positions, hidden, mix64, need, quoted, rolled_hashes, shingle_sets, signed, sized_broadcast, slices, tree_sum, word_hashes
from plumbline.operators.components import components
from plumbline.session import cut_lineage

#: Counters of the frequency sketch, and how far above the mean (in standard deviations) a counter counts as frequent.
SKETCH_BITS, SKETCH_CHUNK, DEVIATIONS = 20, 1 << 16, 10.0
#: Nodes in a block of the block comparison.
BLOCK = 512
#: Bits of the parity map of a set.
PARITY_BITS = 512


def _set_batches(batches, width: int):
    """(ids, sets) of bounded parts of the record batches."""
    for batch in batches:
        texts = batch.column("text").cast(pa.large_binary()).to_pylist()
        for lo, hi in slices(texts):
            yield batch.column("id").slice(lo, hi - lo), shingle_sets(texts[lo:hi], width)


def _sketch(docs: DataFrame, width: int) -> np.ndarray:
    """One bit a counter: does this counter hold clearly more tokens than the mean."""

    def count(batches):
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary()).to_pylist()
            for lo, hi in slices(texts):
                tokens = rolled_hashes(word_hashes(texts[lo:hi])[0], width)
                total += np.bincount((tokens & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64), minlength=1 << SKETCH_BITS)
        part = TaskContext.get().partitionId()
        for k in range(0, 1 << SKETCH_BITS, SKETCH_CHUNK):
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([k], pa.int32()), "part": pa.array([part], pa.int32()), "data": [total[k : k + SKETCH_CHUNK].tobytes()]})

    counts = np.zeros(1 << SKETCH_BITS, np.int64)
    for chunk, values in tree_sum(docs.select("text").mapInArrow(count, "chunk int, part int, data binary"), "int64").items():
        counts[chunk : chunk + SKETCH_CHUNK] = values
    mean = counts.mean()
    return counts > max(16.0, mean + DEVIATIONS * np.sqrt(max(mean, 1.0)))


def part_keys(tokens: np.ndarray, percent: int) -> np.ndarray:
    """Keys of token combinations: any set similar enough has one of them too.

    Size classes grow by ``100 / percent``, so similar sizes fall into one class or two neighbours; group g holds the
    classes g and g + 1. Two sets of a group differ in at most ``d`` tokens. On a ring of ``2 d + 1 + e`` parts they agree
    in at least ``e + 1`` pairs of neighbouring parts, so pairs of two empty parts are left out when a set has at most
    ``e`` of them, and kept otherwise.
    """
    n = len(tokens)
    ratio = 100 / percent * (1 + 1e-6)
    size_class = int(np.log(n) / np.log(ratio) + 1e-9)
    keys = []
    for group in (size_class - 1, size_class):
        largest = ratio ** (group + 2)
        differ = int(2 * largest * (100 - percent) / (100 + percent) + 1e-6)
        spare = differ // 20
        parts = 2 * differ + 1 + spare
        with np.errstate(over="ignore"):
            spread = mix64(tokens * np.uint64(0xD6E8FEB86659FD93) + np.uint64(group + 2))
            part = (spread % np.uint64(parts)).astype(np.int64)
            sums = np.zeros(parts, np.uint64)
            np.add.at(sums, part, mix64(spread))
            filled = np.bincount(part, minlength=parts) > 0
            ring = np.arange(parts, dtype=np.uint64) + np.uint64((group + 2) << 40)
            combined = mix64(mix64(sums + ring) * np.uint64(3) + np.roll(sums, -1))
        empty = ~(filled | np.roll(filled, -1))
        keys.append(combined if empty.sum() > spare else combined[~empty])
    return np.concatenate(keys)


def prefix_keys(tokens: np.ndarray, frequent: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Index keys of one set (sorted distinct hashes): its rare prefix tokens, and token combinations if these don't fill the prefix."""
    n = len(tokens)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    plain = n - -(-percent * n // 100) + 1
    common = frequent[(tokens & np.uint64(len(frequent) - 1)).astype(np.int64)]
    singles = tokens[~common][:plain]
    return singles, part_keys(tokens, percent) if len(singles) < plain else np.zeros(0, np.uint64)


def _heads(docs: DataFrame, width: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """Per row: its id, set size, node (hash of the set) and index keys."""
    bits = np.packbits(frequent).tobytes()

    def map_rows(batches):
        marks = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)
        for ids, sets in _set_batches(batches, width):
            nodes, singles, pairs, parity = [], [], [], []
            for s in sets:
                one, two = prefix_keys(s, marks, percent)
                nodes.append(set_hash(s))
                parity.append(parity_map(s))
                singles.append(signed(one))
                pairs.append(signed(two))
            yield pa.RecordBatch.from_arrays(
                [
                    ids, pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.int64()),
                    pa.array(singles, pa.list_(pa.int64())), pa.array(pairs, pa.list_(pa.int64())), pa.array(parity, pa.list_(pa.int64())),
                ],
                names=["id", "n", "node", "singles", "pairs", "parity"],
            )

    return docs.mapInArrow(map_rows, "id bigint, n bigint, node bigint, singles array<bigint>, pairs array<bigint>, parity array<bigint>")


def parity_map(tokens: np.ndarray) -> np.ndarray:
    """Whether an odd number of tokens falls on each of ``PARITY_BITS`` places, as 64-bit words.

    Two maps differ in at most as many places as the sets differ in tokens, and, unlike a map of the places that are hit, they do not
    fill up: unrelated sets differ in about half of the places.
    """
    with np.errstate(over="ignore"):
        place = (mix64(tokens * np.uint64(0xA24BAED4963EE407)) % np.uint64(PARITY_BITS)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=PARITY_BITS) & 1).astype(bool)).view(np.int64)


def set_hash(tokens: np.ndarray) -> int:
    """One 64-bit name of a set, from its sorted tokens and their places."""
    with np.errstate(over="ignore"):
        place = np.arange(1, len(tokens) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return int(signed(mix64(np.array([(mix64(tokens ^ place)).sum(dtype=np.uint64) + np.uint64(len(tokens))], np.uint64)))[0])


def _names(docs: DataFrame, width: int) -> DataFrame:
    """Per row: its id, set size and node (null without shingles)."""

    def map_rows(batches):
        for ids, sets in _set_batches(batches, width):
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([len(s) for s in sets], pa.int64()), pa.array([set_hash(s) if len(s) else None for s in sets], pa.int64())],
                names=["id", "n", "node"],
            )

    return docs.mapInArrow(map_rows, "id bigint, n bigint, node bigint")


def _tokens(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(node, tokens): whole sets of the wanted nodes, made again from the text of one row each."""

    def map_rows(batches):
        for ids, sets in _set_batches(batches, width):
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([set_hash(s) for s in sets], pa.int64()), pa.array([signed(s) for s in sets], pa.list_(pa.int64()))],
                names=["id", "node", "tokens"],
            )

    found = docs.mapInArrow(map_rows, "id bigint, node bigint, tokens array<bigint>")
    rows = cut_lineage(wanted.select(F.col("node").alias("node_")).distinct().join(nodes.select(F.col("node").alias("node_"), F.col("id").alias("first_id")), "node_"))
    same = (F.col("node") == F.col("node_")) & F.col("id").eqNullSafe(F.col("first_id"))
    return cut_lineage(found.join(sized_broadcast(rows), same).select("node", "tokens"))


def _sides(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """Pairs with n, part and reach (the largest token) of both nodes; reach is made below the joins, once a node."""
    parts = parts.withColumn("reach", F.coalesce(F.array_max("part"), F.lit(-1)))
    left = parts.select(F.col("node").alias("u"), F.col("n").alias("nu"), F.col("part").alias("pu"), F.col("reach").alias("ru"))
    right = parts.select(F.col("node").alias("v"), F.col("n").alias("nv"), F.col("part").alias("pv"), F.col("reach").alias("rv"))
    return pairs.join(left, "u").join(right, "v")


def _enough(shared: Column, percent: int) -> Column:
    return F.lit(100) * shared >= F.lit(percent) * (F.col("nu") + F.col("nv") - shared)


def _near(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs that sizes and parity maps don't rule out: similar sets differ in few tokens. Small rows, before any token moves."""
    side = lambda a: nodes.select(F.col("node").alias(a), F.col("n").alias(f"n{a}"), F.col("parity").alias(f"s{a}"))
    met = pairs.join(side("u"), "u").join(side("v"), "v")
    fits = F.lit(100) * F.least("nu", "nv") >= F.lit(percent) * F.greatest("nu", "nv")
    differ = F.aggregate(F.zip_with("su", "sv", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda a, x: a + x)
    return cut_lineage(met.filter(fits & (F.lit(100 + percent) * differ <= F.lit(100 - percent) * (F.col("nu") + F.col("nv")))).select("u", "v"))


def _likely(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs that sizes, parity maps and prefixes don't rule out.

    Up to the smaller of the last rare prefix tokens, both prefixes hold all rare tokens: two sets share at most what they
    share there and the smaller rest.
    """
    fits = F.lit(100) * F.least("nu", "nv") >= F.lit(percent) * F.greatest("nu", "nv")
    met = _sides(_near(pairs, nodes, percent), nodes.select("node", "n", F.col("singles").alias("part"))).filter(fits)
    known = [F.size(F.filter(p, lambda x: (x <= F.col("ru")) & (x <= F.col("rv")))) for p in ("pu", "pv")]
    shared = F.size(F.array_intersect("pu", "pv")).cast("bigint")
    bound = shared + F.least(F.col("nu") - known[0], F.col("nv") - known[1])
    return cut_lineage(met.filter(_enough(bound, percent)).select("u", "v"))


def _linked(likely: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose whole sets are similar enough."""
    met = _sides(likely, sets.select("node", F.size("tokens").cast("bigint").alias("n"), F.col("tokens").alias("part")))
    shared = F.size(F.array_intersect("pu", "pv")).cast("bigint")
    return cut_lineage(met.filter(_enough(shared, percent)).select("u", "v").distinct())


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("u", "v")).alias("node"))


def _entries(singles: DataFrame) -> DataFrame:
    return singles.select("key", F.explode("members").alias("node"))


def _open_lists(entries: DataFrame, labels: DataFrame) -> DataFrame:
    """Entries of the lists that hold several components."""
    seen = entries.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    several = seen.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("key")
    return seen.join(several, "key")


def _cross_pairs(rest: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) of different components in lists of rare tokens that may be similar by the places of the token in both prefixes.

    If it is the first token that two sets share, they share at most what follows it in both; a similar pair stands in the list of
    its first shared token. The entries grow with the table, so they are shuffled, never sent to the driver.
    """
    placed = nodes.select("node", "n", "singles").join(rest.hint("merge"), "node")
    left = F.col("n") - F.array_position("singles", F.col("key")) + 1
    placed = cut_lineage(placed.select("key", "node", "component", "n", left.alias("left")))
    x = placed.toDF("key", "u", "cu", "nu", "lu")
    y = placed.toDF("key", "v", "cv", "nv", "lv")
    enough = F.lit(100 + percent) * F.least("lu", "lv") >= F.lit(percent) * (F.col("nu") + F.col("nv"))
    return x.join(y, "key").filter(enough & F.expr("u < v AND cu <> cv")).select("u", "v").distinct()


def _ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("u"), F.greatest(a, b).alias("v")]


def _block_links(entries: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) between components among nodes that combinations connect, by pairs of blocks of nodes."""
    seeds = entries.groupBy("key").agg(F.min("node").alias("seed"))
    edges = entries.join(seeds, "key").filter("node <> seed").select("node", "seed").distinct()
    clusters = components(edges, "node", "seed").select("node", F.col("component").alias("cluster"))

    def compare(key, rows):
        return pd.DataFrame(_spanning_links(rows, key[0] == key[1], percent), columns=["u", "v"]).astype("int64")

    members = entries.select("node", "component").distinct().join(clusters, "node")
    return cut_lineage(_block_tasks(members, sets, percent).applyInPandas(compare, "u bigint, v bigint"))


def _link_counts(labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, n_links): all links of each node of the components (node, component), which hold every link by now.

    Two nodes of one component have one link; larger components are compared whole, by pairs of blocks. A task returns
    one row a node.
    """
    sizes = labels.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    labels = cut_lineage(labels.join(sizes, "component"))
    pairs = labels.filter("size = 2").select("node", F.lit(1).cast("bigint").alias("n_links"))

    def compare(key, rows):
        return _counted_links(rows, key[0] == key[1], percent)

    members = labels.filter("size > 2").select("node", "component", F.col("component").alias("cluster"))
    counted = _block_tasks(members, sets, percent).applyInPandas(compare, "node bigint, n_links bigint")
    return pairs.unionByName(counted.groupBy("node").agg(F.sum("n_links").alias("n_links")))


def _block_tasks(members: DataFrame, sets: DataFrame, percent: int):
    """The members (node, component, cluster) with their sets, grouped by all pairs of blocks that sizes don't rule out."""
    sets = sets.dropDuplicates(["node"])
    sizes = sets.select("node", F.size("tokens").cast("bigint").alias("n"))
    placed = global_positions(members.join(sizes, "node"), ["cluster", "n", "node"]).withColumn("block", F.floor(F.col("position") / BLOCK))
    placed = cut_lineage(placed.join(sets.select("node", "tokens"), "node"))
    blocks = cut_lineage(placed.groupBy("cluster", "block").agg(F.min("n").alias("least"), F.max("n").alias("most")))
    later = blocks.select("cluster", F.col("block").alias("other"), F.col("least").alias("other_least"))
    tasks = cut_lineage(
        blocks.join(later, "cluster").filter((F.col("other") >= F.col("block")) & (F.lit(100) * F.col("most") >= F.lit(percent) * F.col("other_least")))
        .select("block", "other").distinct()
    )
    sides = tasks.select("block", F.col("block").alias("i"), F.col("other").alias("j")).unionByName(
        tasks.filter("block <> other").select(F.col("other").alias("block"), F.col("block").alias("i"), F.col("other").alias("j"))
    )
    copies = placed.select("block", "cluster", "component", "n", "node", "tokens").join(sides, "block")
    return copies.groupBy("i", "j")


def _close(rows: pd.DataFrame, same: bool, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the one and of the other block, and which pairs of one cluster are similar enough: counts of shared tokens by token."""
    blocks = rows["block"].to_numpy()
    left = np.flatnonzero(blocks == blocks.min())
    right = left if same else np.flatnonzero(blocks != blocks.min())
    sets = rows["tokens"].to_numpy()
    shared = np.zeros((len(left), len(right)), np.int32)
    flat = np.concatenate([np.asarray(s, np.int64) for s in sets])
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    starts = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
    ends = np.append(starts[1:], len(flat))
    row_of = np.full(len(sets), -1)
    row_of[left] = np.arange(len(left))
    col_of = np.full(len(sets), -1)
    col_of[right] = np.arange(len(right))
    for lo, hi in zip(starts[ends - starts > 1], ends[ends - starts > 1]):
        who = owner[lo:hi]
        i, j = row_of[who], col_of[who]
        shared[np.ix_(i[i >= 0], j[j >= 0])] += 1
    sizes, cluster = rows["n"].to_numpy(), rows["cluster"].to_numpy()
    union = sizes[left][:, None] + sizes[right][None, :] - shared
    close = (100 * shared.astype(np.int64) >= percent * union) & (cluster[left][:, None] == cluster[right][None, :])
    return left, right, close


def _counted_links(rows: pd.DataFrame, same: bool, percent: int) -> pd.DataFrame:
    """Links of each node among the nodes of two blocks (or of one, where every pair stands on both sides)."""
    left, right, close = _close(rows, same, percent)
    if same:
        np.fill_diagonal(close, False)
    count = np.zeros(len(rows), np.int64)
    count[left] = close.sum(axis=1)
    if not same:
        count[right] = close.sum(axis=0)
    return pd.DataFrame({"node": rows["node"], "n_links": count})[count > 0]


def _spanning_links(rows: pd.DataFrame, same: bool, percent: int) -> list[tuple[int, int]]:
    """Links that join components among the nodes of two blocks (or of one)."""
    left, right, close = _close(rows, same, percent)
    component, node = rows["component"].to_numpy(), rows["node"].to_numpy()
    close &= component[left][:, None] != component[right][None, :]
    parent = {c: c for c in set(component.tolist())}

    def root(c):
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    out = []
    for i, j in zip(*np.nonzero(close)):
        a, b = left[i], right[j]
        ra, rb = root(int(component[a])), root(int(component[b]))
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
            out.append((int(min(node[a], node[b])), int(max(node[a], node[b]))))
    return out


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, percent: int = 85, count_links: bool = True,
) -> DataFrame:
    """One row per input row: (id, n_shingles, node, component_id, n_links); without ``count_links`` the last is left out.

    ``node`` names the row's set, so rows with equal sets share it; ``component_id`` is the smallest id reachable over
    links; ``n_links`` counts all links of the node to other sets. Components are found by a spanning part of the links; then
    all pairs within a component are compared, since no link leaves it.
    Rows without words have no shingles, node null and are linked with nothing. A null text is an empty one. A row with a
    null id is linked like others but names no component, so a component of null ids only has a null name. Repeated
    ids are separate rows. Empty tables give empty results. Extra columns are ignored.
    """
    need(docs, id_col, text_col)
    rows = docs.select(quoted(id_col).cast("bigint").alias("id"), quoted(text_col).alias("text"))
    frequent = _sketch(rows, width)
    heads = _heads(rows, width, percent, frequent)
    nodes = cut_lineage(
        heads.filter("n > 0").groupBy("node", "n").agg(F.min("id").alias("id"), F.first("singles").alias("singles"), F.first("pairs").alias("pairs"), F.first("parity").alias("parity"))
    )
    singles = cut_lineage(
        nodes.select("node", F.explode("singles").alias("key")).groupBy("key").agg(F.collect_list("node").alias("members")).filter(F.size("members") > 1)
    )
    doubles = nodes.select("node", F.explode("pairs").alias("key"))
    shared = doubles.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").select("key")
    doubles = cut_lineage(doubles.join(shared, "key"))

    # every list against its smallest node
    first = doubles.groupBy("key").agg(F.min("node").alias("pivot"))
    star_double = doubles.join(first, "key").filter("node <> pivot").select(*_ordered("node", "pivot"))
    star_single = singles.select(F.array_min("members").alias("pivot"), F.explode("members").alias("node")).filter("node <> pivot").select(*_ordered("node", "pivot"))
    star = cut_lineage(star_single.unionByName(star_double).distinct())
    likely = _likely(star, nodes, percent)
    star_sets = _tokens(rows, nodes, _ends(likely), width)
    links = _linked(likely, star_sets, percent)
    labels = components(links, "u", "v").select("node", "component")

    # what is left is compared across components
    rest = cut_lineage(_open_lists(_entries(singles), labels))
    cross = _cross_pairs(rest, nodes, percent).join(star, ["u", "v"], "left_anti")
    likely = _likely(cut_lineage(cross), nodes, percent)
    still = cut_lineage(_open_lists(doubles, labels))
    sets = _tokens(rows, nodes, _ends(likely).unionByName(still.select("node")), width)
    links = links.unionByName(_linked(likely, sets, percent)).unionByName(_block_links(still, sets, percent))
    labels = components(links, "u", "v").select("node", "component")

    named = nodes.select("node", "id").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = named.groupBy("component").agg(F.min("id").alias("component_id"))
    final = named.join(smallest, "component").select("node", "component_id")
    if count_links:
        final = final.join(_link_counts(labels, star_sets.unionByName(sets), percent), "node", "left")
    final = cut_lineage(final)
    members = _names(rows, width)
    return members.join(final, "node", "left").select(
        "id", F.col("n").alias("n_shingles"), "node",
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
        *([F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links")] if count_links else []),
    )


def one_of_each_group(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, percent: int = 85, keep_null_ids: bool = True,
) -> DataFrame:
    """One row of each group of near copies, that of the smallest id; rows without words stay.

    Rows are told apart by id and text, so a repeated id takes no other text with it; of rows with the kept id and several
    texts of the group, or of repeated rows, one stays. Rows with a null id all stay, or with ``keep_null_ids=False`` are
    judged like others, after the rows with an id.
    """
    need(docs, id_col, text_col)
    row_key = F.xxhash64(quoted(id_col), quoted(text_col))
    rows = docs.select(row_key.alias("key"), quoted(text_col).alias("text"))
    found = jaccard_components(rows, "key", "text", width, percent, count_links=False).filter("n_shingles > 0")
    found = found.groupBy(F.col("id").alias("key"), "component_id").agg(F.count(F.lit(1)).alias("n"))
    ids = docs.select(row_key.alias("key"), quoted(id_col).cast("bigint").alias("id")).distinct()
    named = cut_lineage(found.join(ids, "key"))
    best = named.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("key")))["key"].alias("best"))
    judged = named.join(best, "component_id")
    judged = cut_lineage(judged.filter("id IS NOT NULL") if keep_null_ids else judged)
    key, gone, several = hidden(docs, "copy_key", "gone_key", "several_key")
    drop = judged.filter("key <> best").select(F.col("key").alias(gone))
    repeated = judged.filter("key = best AND n > 1").select(F.col("key").alias(several))
    kept = docs.withColumn(key, row_key).join(drop, F.col(key) == F.col(gone), "left_anti")
    same = F.col(key) == F.col(several)
    once = kept.join(repeated, same, "left_semi").dropDuplicates([key])
    return kept.join(repeated, same, "left_anti").unionByName(once).select(*[quoted(c) for c in docs.columns])
