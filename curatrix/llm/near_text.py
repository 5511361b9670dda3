"""Documents whose five-word shingles have a Jaccard similarity of 0.8 or more, found without missing any.

The SimHash operator comes first: sets whose fingerprints meet in its inverted index over byte positions, and the checked links among them. They
are few of all similar sets, since a similarity of 0.8 is often ten bits away, so an exact search follows for what they leave apart:

Under one order of all shingles, two sets of similarity t or more share a shingle among the first n - ceil(t n) + 1 of each: a posting
is named by such a shingle, so every pair meets in one. Which order is taken changes the work only; shingles that many
texts have come last. Most pairs that meet are not alike: counts of each set's shingles by their last bits bound what two sets can
share, and only pairs that pass this bound are verified, on the whole sets. Postings of many sets give no pairs: the counts
of those that hang together over them meet in one task, and then the whole sets of those that these leave together, once each, which gives a spanning forest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.llm import simhash
from curatrix.llm.common import ASCII_LOWER, JOIN, SPACES, WordNames, among, filters, maybe_in, mix, parted, raw, shuffles_dropped, written
from curatrix.operators.components import connected_components

SHINGLE = 5
#: Similarity as a fraction, so that the bounds are whole numbers.
ALIKE, OF = 4, 5
#: Shingles that are moved to the end of the order, at most.
COMMON = 1 << 17
COUNT_BYTES = 4 << 20
PIVOTS = 1
#: Members of a posting that are compared as pairs of rows; in larger ones the sets themselves meet.
CROWDED = 32
#: Bytes of whole sets that meet in a task.
PLACE_BYTES = 4 << 20
IN_WORD = np.ones(256, bool)
IN_WORD[[*SPACES.encode()]] = False
NAMES = WordNames()


def shingle_set(text: bytes | None) -> np.ndarray:
    """The sorted 64-bit names of all shingles; a text of fewer words is one shingle."""
    flat = np.frombuffer((text or b"").translate(ASCII_LOWER), np.uint8)
    edge = np.diff(np.concatenate([[False], IN_WORD[flat], [False]]).view(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.empty(0, np.int64)
    words, k = NAMES(flat, starts, ends), min(SHINGLE, len(starts))
    made = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        made = mix(made * JOIN + words[i:i + len(made)])
    return np.unique(made.view(np.int64))


def name_of(shingles: np.ndarray) -> bytes:
    """16 bytes that stand for the whole set."""
    return hashlib.md5(shingles.tobytes()).digest()


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return OF * both >= ALIKE * (len(a) + len(b) - both)


def tally(shingles: np.ndarray) -> bytes:
    """How many shingles have the same last bits, a byte for each four to eight shingles; nothing if a count needs more than a byte."""
    buckets = 1 << max((len(shingles) >> 2).bit_length() - 1, 0)
    counts = np.bincount(shingles & (buckets - 1), minlength=buckets)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def may_be_alike(a: bytes, b: bytes) -> bool:
    """False only if the tallies prove that the sets are not alike: they share at most the smaller count of each bucket."""
    if not a or not b:
        return True
    least = min(len(a), len(b))
    x, y = (np.frombuffer(t, np.uint8).astype(np.int64).reshape(-1, least).sum(axis=0) for t in (a, b))
    both = int(np.minimum(x, y).sum())
    return OF * both >= ALIKE * (int(x.sum()) + int(y.sum()) - both)


def prefix(shingles: np.ndarray, common: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The first n - ceil(0.8 n) + 1 shingles: rare ones by value, then those of ``common`` (sorted) by their ranks from 1."""
    n = len(shingles)
    rank = np.zeros(n, np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
        rank = np.where(common[at] == shingles, ranks[at], 0)
    return shingles[np.lexsort((shingles, rank))[: n + ALIKE * -n // OF + 1] if n else slice(0)]


def named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, digest, node, tally, fp): the text's digest, the name of its set, the tally and the fingerprint of it, for every row."""
    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(name_of(s), tally(s), simhash.majority(s)) for s in (shingle_set(t.as_py()) for t in batch.column(2))]
            nodes, tallies, fps = (pa.array([m[i] for m in made], kind) for i, kind in enumerate((pa.binary(), pa.binary(), pa.int64())))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), nodes, tallies, fps], ["doc_id", "digest", "node", "tally", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_digest(text_col), raw(text_col).alias("raw")).mapInArrow(
        name, "doc_id long, digest string, node binary, tally binary, fp long")


def text_digest(text_col: str) -> Column:
    return F.coalesce(F.md5(F.col(text_col).cast("string")), F.lit("")).alias("digest")


def common_shingles(docs: DataFrame, text_col: str) -> np.ndarray:
    """The shingles of most texts, the rarest first. Only what a few megabytes of text hold twice is counted."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, size = {}, 0

        def counted() -> pa.RecordBatch:
            values, n = np.unique(np.concatenate([np.empty(0, np.int64), *sets.values()]), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(values[n > 1]), pa.array(n[n > 1].astype(np.int64))], ["shingle", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                made = shingle_set(text)
                sets[name_of(made)] = made
                size += len(text or b"")
                if size >= COUNT_BYTES:
                    yield counted()
                    sets, size = {}, 0
        yield counted()

    found = docs.select(raw(text_col).alias("raw")).mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    with shuffles_dropped(docs.sparkSession):
        top = found.where("n > 2").orderBy(F.desc("n"), "shingle").limit(COMMON).collect()
    return np.array([r.shingle for r in reversed(top)], np.int64)


def prefixes(docs: DataFrame, text_col: str, common: np.ndarray) -> DataFrame:
    """(shingle, n, node): the prefix of each set. Shingles that only one set has are left out, but for what a filter of fixed size lets through.

    Most prefix shingles are in one set only, so tasks first send the bare shingles of a few megabytes of text, once each, and
    the names of sets only for those that came back.
    """
    order = np.argsort(common)
    sent = docs.sparkSession.sparkContext.broadcast((common[order], order + 1))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]]:
        """Names of the sets of a few megabytes of text, their sizes, the sizes of their prefixes, and these in one array."""
        sets, size = {}, 0

        def given() -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
            firsts = [p for _, p in sets.values()]
            return ([*sets], np.array([n for n, _ in sets.values()], np.int64), np.array([*map(len, firsts)], np.int64),
                    np.concatenate([np.empty(0, np.int64), *firsts]))

        for batch in batches:
            for text in batch.column(0):
                text = text.as_py() or b""
                made = shingle_set(text)
                sets[name_of(made)] = len(made), prefix(made, *sent.value)
                size += len(text) + 64
                if size >= COUNT_BYTES:
                    yield given()
                    sets, size = {}, 0
        yield given()

    def bare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, shingles in cut(batches):
            values, n = np.unique(shingles, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(np.minimum(n, 2))], ["key", "n"])

    raws = docs.select(raw(text_col).alias("raw"))
    # A copy of a text in another task counts its shingles once more; that lets them through, no more.
    seen, _ = filters(raws.mapInArrow(bare, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n > 1"))
    twice = docs.sparkSession.sparkContext.broadcast(seen)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nodes, n, many, shingles in cut(batches):
            hit = np.flatnonzero(among(shingles.view(np.uint64), twice.value))
            owner = np.repeat(np.arange(len(nodes)), many)[hit]
            for at in range(0, len(hit), 20_000):
                part = owner[at:at + 20_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shingles[hit[at:at + 20_000]]), pa.array(n[part]), pa.array(nodes, pa.binary()).take(pa.array(part))], ["shingle", "n", "node"])

    return raws.mapInArrow(named, "shingle long, n long, node binary")


def postings(docs: DataFrame, text_col: str, common: np.ndarray) -> DataFrame:
    """(shingle, members): the (n, node) of each posting with at least two different sets, in order."""
    return prefixes(docs, text_col, common).groupBy("shingle").agg(
        F.sort_array(F.collect_set(F.struct("n", "node"))).alias("members")).where("size(members) > 1")


def candidates(posted: DataFrame, pivots: int) -> DataFrame:
    """(a, b): the first ``pivots`` members of each posting with all behind them whose size still allows the similarity."""
    first = posted.select("members", F.posexplode(F.slice("members", 1, pivots)).alias("i", "a"))
    labelled = "component" in posted.schema["members"].dataType.elementType.names

    def wanted(b: Column) -> Column:
        close = OF * F.col("a.n") >= ALIKE * b["n"]
        return close & (F.col("a.component") != b["component"]) if labelled else close

    # Members that need no comparing are left out of the list before it is opened.
    both = first.select("a", F.explode(F.filter(F.slice("members", F.col("i") + 2, F.size("members")), wanted)).alias("b"))
    return both.select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct()


def possible(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) that their tallies do not rule out."""
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [may_be_alike(x.as_py(), y.as_py()) for x, y in zip(batch.column(2), batch.column(3))]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    first, second = (sets.select(F.col("node").alias(s), F.col("tally").alias(f"tally_{s}")) for s in "ab")
    return pairs.join(first, "a").join(second, "b").select("a", "b", "tally_a", "tally_b").mapInArrow(check, "a binary, b binary")


def whole_sets(docs: DataFrame, text_col: str, sets: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, items): the sets that ``wanted`` (node, once each) names; only their texts are read as sets."""
    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = {name_of(s): s.tobytes() for s in (shingle_set(t.as_py()) for t in batch.column(0))}
            yield pa.RecordBatch.from_arrays([pa.array([*made], pa.binary()), pa.array([*made.values()], pa.binary())], ["node", "items"])

    digests = sets.join(wanted, "node", "left_semi").select("digest")
    texts = maybe_in(docs.select(text_digest(text_col), raw(text_col).alias("raw")), digests, "digest").select("raw")
    return texts.mapInArrow(shingled, "node binary, items binary").join(wanted, "node", "left_semi").groupBy("node").agg(F.first("items").alias("items"))


def verified(docs: DataFrame, text_col: str, sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) that are alike."""
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [alike(np.frombuffer(x.as_py(), np.int64), np.frombuffer(y.as_py(), np.int64)) for x, y in zip(batch.column(2), batch.column(3))]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    wanted = written(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct(), "paired")
    # Both sides of the pairs read one exchange of this.
    found = whole_sets(docs, text_col, sets, wanted)
    first, second = (found.select(F.col("node").alias(s), F.col("items").alias(f"items_{s}")) for s in "ab")
    return pairs.join(first, "a").join(second, "b").select("a", "b", "items_a", "items_b").mapInArrow(check, "a binary, b binary")


def fingerprint_pairs(sets: DataFrame) -> DataFrame:
    """(a, b): sets that the SimHash operator links; those of one fingerprint hang on the first of them."""
    first = written(sets.groupBy("fp").agg(F.min("node").alias("first")), "set-fingerprints")
    one, two = (first.select(F.col("fp").alias(s), F.col("first").alias(f"first_{s}")) for s in "ab")
    near = simhash.near_links(first.select("fp")).join(one, "a").join(two, "b").select(F.col("first_a").alias("a"), F.col("first_b").alias("b"))
    equal = sets.join(first, "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    return near.unionByName(equal)


def apart(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(shingle, members) with the component of each member, for postings that have more than one. ``members``: shingle, n, node."""
    return members.join(labels, "node", "left").groupBy("shingle").agg(
        F.sort_array(F.collect_list(F.struct("n", "node", F.coalesce("component", "node").alias("component")))).alias("members")).where(
            F.size(F.array_distinct("members.component")) > 1)


def clouds_of(edges: DataFrame, name: str = "component") -> DataFrame:
    """(node, ``name``): the components of ``edges`` (a, b)."""
    with shuffles_dropped(edges.sparkSession):
        return connected_components(edges).withColumnRenamed("component", name)


def forest(sets: list[np.ndarray], labels: np.ndarray, sides: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Alike sets that join different ``labels``, as edges of a spanning forest; with ``sides`` only sets of different sides are compared.

    An inverted index of the sets gives what a set shares with all others at once. Sets that share too few of their shingles with
    any other are passed over.
    """
    sizes, labels, out = np.array([*map(len, sets)], np.int64), labels.copy(), []
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    head = np.concatenate([[True], flat[order[1:]] != flat[order[:-1]]])
    which = np.empty(len(flat), np.int64)
    which[order] = np.cumsum(head) - 1
    begin, holders = np.flatnonzero(head), owner[order]
    end = np.append(begin[1:], len(flat))
    for i, own in enumerate(np.split(which, np.cumsum(sizes)[:-1])):
        own = own[end[own] - begin[own] > 1]
        if not len(own) or OF * len(own) < ALIKE * sizes[i] or labels.min() == labels.max():
            continue
        both = np.bincount(np.concatenate([holders[a:b] for a, b in zip(begin[own].tolist(), end[own].tolist())]), minlength=len(sets))
        good = (OF * both >= ALIKE * (sizes + sizes[i] - both)) & (labels != labels[i])
        if sides is not None:
            good &= sides != sides[i]
        for j in np.flatnonzero(good).tolist():
            if labels[j] != labels[i]:
                out.append((i, j))
                labels[labels == labels[j]] = labels[i]
    return out


def close_forest(tallies: list[bytes], sizes: np.ndarray, components: np.ndarray, sides: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Sets of different ``components`` whose tallies do not rule them out, as edges of a spanning forest of all such pairs.

    The edges are not known to be alike, so sets hang together by them alone, not by their components. Sets are laid by size, and
    each is held against the larger ones that its size allows.
    """
    order = np.argsort(sizes, kind="stable")
    lengths, labels, out = np.array([*map(len, tallies)], np.int64), np.arange(len(tallies)), []
    held = {}
    for length in np.unique(lengths[lengths > 0]).tolist():
        # A set at most a quarter larger has a tally of this length or twice as long; an empty one says nothing.
        near = order[np.isin(lengths[order], (0, length, 2 * length))]
        table = np.zeros((len(near), length), np.uint16)
        for k, i in enumerate(near.tolist()):
            table[k] = np.frombuffer(tallies[i], np.uint8).reshape(-1, length).sum(axis=0) if tallies[i] else 0
        held[length] = near, table
    held[0] = order, None
    for i in order.tolist():
        near, table = held[lengths[i]]
        least, most = np.searchsorted(sizes[near], (sizes[i], OF * sizes[i] // ALIKE + 1))
        at = np.arange(least, most)
        other = near[at]
        good = (labels[other] != labels[i]) & (components[other] != components[i])
        if sides is not None:
            good &= sides[other] != sides[i]
        at, other = at[good], other[good]
        if table is not None and len(at):
            own = np.frombuffer(tallies[i], np.uint8)
            both = np.minimum(table[at], own).sum(axis=1, dtype=np.int64)
            good = (lengths[other] == 0) | (OF * both >= ALIKE * (sizes[other] + sizes[i] - both))
            other = other[good]
        if len(other):
            joined, first = np.unique(labels[other], return_index=True)
            out += [(i, j) for j in other[first].tolist()]
            labels[np.isin(labels, joined)] = labels[i]
            if labels.min() == labels.max():
                break
    return out


def crowd_places(rows: DataFrame, clouds: DataFrame) -> DataFrame:
    """(place, row, col, tile, node, component): where sets of ``rows`` (shingle, node, component, size) meet, ``size`` in bytes.

    Sets of one of ``clouds`` (node, cloud) are one place, so each of them is sent once; sets of no cloud are left out. A cloud that is too much
    for a task is cut in tiles, and each pair of tiles meets; or else each posting in it is a place of its own, cut in the same way, if
    that moves less: texts that have much in common are together in many postings, others in few.
    """
    def cut(total: Column) -> Column:
        return F.when(total > PLACE_BYTES, F.ceil(2 * total / PLACE_BYTES)).otherwise(1).cast("int")

    held = written(rows.join(clouds, "node"), "crowd")
    nodes = written(held.groupBy("cloud", "node").agg(F.first("component").alias("component"), F.first("size").alias("size")), "crowd-nodes")
    whole = written(nodes.groupBy("cloud").agg(F.sum("size").alias("total")).withColumn("tiles", cut(F.col("total"))), "clouds")
    large = whole.where("tiles > 1").select("cloud", (F.col("total") * F.col("tiles")).alias("moved"))
    single = written(held.join(large.select("cloud"), "cloud", "left_semi").groupBy("cloud", "shingle").agg(F.sum("size").alias("total")).withColumn(
        "tiles", cut(F.col("total"))), "crowd-tiles")
    opened = written(single.groupBy("cloud").agg(F.sum(F.col("total") * F.col("tiles")).alias("each")).join(large, "cloud").where("each < moved").select(
        "cloud"), "opened-clouds")
    together = nodes.join(whole, "cloud").join(opened, "cloud", "left_anti").select(F.col("cloud").alias("place"), "tiles", "node", "component")
    # Longer than the name of a cloud, so no cloud has the same.
    postings = held.join(single.join(opened, "cloud", "left_semi"), ["cloud", "shingle"]).select(
        F.concat("cloud", F.unhex(F.lpad(F.hex("shingle"), 16, "0"))).alias("place"), "tiles", "node", "component")
    met = together.unionByName(postings).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    other = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(F.least("tile", t).alias("row"), F.greatest("tile", t).alias("col")))
    return met.select("place", F.explode(other).alias("at"), "tile", "node", "component").select("place", "at.row", "at.col", "tile", "node", "component")


def meetings(places: DataFrame, given: DataFrame, edges_of: Callable[..., list[tuple[int, int]]]) -> DataFrame:
    """(a, b): ``edges_of`` what the sets of each place are given (node, n, given), their sizes, components and tiles."""
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []

        def found() -> pa.RecordBatch:
            names, tiles, components, sizes, items = zip(*rows)
            numbers = {c: k for k, c in enumerate(dict.fromkeys(components))}
            edges = edges_of(items, np.array(sizes, np.int64), np.array([numbers[c] for c in components]), np.array(tiles) if at[1] != at[2] else None)
            return pa.RecordBatch.from_arrays([pa.array([names[e[k]] for e in edges], pa.binary()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            for place, row, col, tile, node, component, n, items in zip(*batch.columns):
                key = place.as_py(), row.as_py(), col.as_py()
                if rows and key != at:
                    yield found()
                    rows = []
                at = key
                rows.append((node.as_py(), tile.as_py(), component.as_py(), n.as_py(), items.as_py()))
        if rows:
            yield found()

    # Rows of a place follow each other.
    return places.join(given, "node").select("place", "row", "col", "tile", "node", "component", "n", "given").repartition(
        "place", "row", "col").sortWithinPartitions("place", "row", "col").mapInArrow(meet, "a binary, b binary")


def crowd_links(docs: DataFrame, text_col: str, sets: DataFrame, crowded: DataFrame) -> DataFrame:
    """(a, b): links that join the components of the members of ``crowded``, each place's as a spanning forest at most.

    Tallies meet first. Only sets that hang together over pairs which these do not rule out meet as a whole, once for each such cloud.
    """
    rows = written(crowded.select("shingle", F.explode("members").alias("m")).select("shingle", "m.node", "m.component", "m.n"), "crowded")
    stars = crowded.select(F.col("members")[0]["node"].alias("a"), F.explode("members.node").alias("b"))
    # A tally has a byte for four to eight shingles.
    tallied = crowd_places(rows.select("shingle", "node", "component", (F.col("n") / 4 + 128).cast("long").alias("size")), clouds_of(stars, "cloud"))
    sized = written(rows.select("node", "n").distinct(), "crowd-sizes")
    tallies = sets.select("node", F.col("tally").alias("given")).join(sized, "node")
    close = written(meetings(written(tallied, "tally-places"), tallies, close_forest), "close")
    places = written(crowd_places(rows.select("shingle", "node", "component", (8 * F.col("n") + 64).alias("size")), clouds_of(close, "cloud")), "places")
    wanted = written(places.select("node").distinct(), "crowd-wanted")
    found = whole_sets(docs, text_col, sets, wanted).select("node", F.lit(0).alias("n"), F.col("items").alias("given"))

    def alike_edges(items: list[bytes], sizes: np.ndarray, components: np.ndarray, sides: np.ndarray | None) -> list[tuple[int, int]]:
        return forest([np.frombuffer(i, np.int64) for i in items], components, sides)

    return meetings(places, found, alike_edges)


def near_links(docs: DataFrame, sets: DataFrame, text_col: str = "text") -> DataFrame:
    """(node, component) for every set that is linked to another over pairs of similarity 0.8 or more. ``sets`` has (node, digest, tally, fp), once each.

    Pairs that fingerprints name are verified first, and sets that these connect are not compared again. Then
    the first members of each posting are compared with all others in it. They are then done with; what is left of a posting goes on if
    it has more than one component. So a cloud of near copies, which is one component by then, costs as many pairs as it has texts.
    Of the others, postings of up to ``CROWDED`` members give all their pairs, and the sets of larger ones meet in tasks, so
    rows grow with the members and no pair of different components is left uncompared.
    """
    def alike_of(pairs: DataFrame) -> DataFrame:
        return written(verified(docs, text_col, sets, written(possible(pairs, sets), "pairs")), "alike")

    def left(posted: DataFrame, done: int) -> DataFrame:
        members = posted.where(F.size("members") > done + 1).select(
            "shingle", F.explode(F.slice("members", done + 1, F.size("members"))).alias("m")).select("shingle", "m.n", "m.node")
        return written(apart(members, clouds_of(reduce(DataFrame.unionByName, links))), "postings-left")

    links = [alike_of(fingerprint_pairs(sets))]
    rest = left(written(postings(docs, text_col, common_shingles(docs, text_col)), "postings"), 0)
    links.append(alike_of(candidates(rest, PIVOTS)))
    rest = left(rest, PIVOTS)
    links.append(alike_of(candidates(rest.where(F.size("members") <= CROWDED), CROWDED)))
    crowded = rest.where(F.size("members") > CROWDED)
    if not crowded.isEmpty():
        links.append(written(crowd_links(docs, text_col, sets, crowded), "crowd-links"))
    return clouds_of(reduce(DataFrame.unionByName, links))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest id (null ids last), then the smallest text digest.

    Texts of less than five words are one shingle; null, empty and blank texts have none and are one component. Of rows that
    share both id and text one stays. Extra columns come back as they are, whatever their names. A text is in memory as a whole, with its shingles
    as 64-bit hashes.
    """
    names = written(named(docs, id_col, text_col), "named-texts")
    rows = names.groupBy("doc_id", "digest", "node").agg(F.count(F.lit(1)).alias("copies"))
    rows = written(rows.withColumn("place", F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "digest")), "named-rows")
    nodes = rows.groupBy("node").agg(F.min("place").alias("least"))
    sets = written(names.groupBy("node").agg(F.min("digest").alias("digest"), F.first("tally").alias("tally"), F.first("fp").alias("fp")), "sets")
    labels = near_links(docs, sets, text_col)
    labelled = written(nodes.join(labels, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component")), "labelled")
    firsts = labelled.groupBy("component").agg(F.min("least").alias("first"))
    chosen = labelled.join(firsts, "component").select("node", "first")
    marks = written(rows.join(chosen, "node").select(
        "doc_id", "digest", (F.col("place") != F.col("first")).alias("gone"), "copies").where("gone OR copies > 1"), "marks").withColumn(
            "key", F.xxhash64("doc_id", "digest"))
    # Columns of the documents are one struct from here on, so that none can clash.
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(id_col).cast("long").alias("doc_id"), text_digest(text_col))
    outside, inside = parted(own.withColumn("key", F.xxhash64("doc_id", "digest")), marks, "key")
    same = ["doc_id", "digest"]

    def met(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        right = right.select(*[F.col(c).alias(f"mark_{c}") for c in same])
        return left.join(right, F.col("doc_id").eqNullSafe(F.col("mark_doc_id")) & (F.col("digest") == F.col("mark_digest")), how)

    # Only texts that may be marked are moved.
    single = outside.unionByName(met(inside, marks, "left_anti"))
    repeated = met(inside, marks.where("NOT gone"), "left_semi").dropDuplicates(same)
    return single.unionByName(repeated).select("doc.*")
