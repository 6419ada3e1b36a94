"""Exact n-gram Jaccard self-join by vertical partitioning.

The n-grams of all texts have one global order: fragment, then how many sets hold it, then hash.
Fragments are cut from the hash, so each holds an even share of every document. Partial overlaps
are counted fragment by fragment and summed per pair.

Which pairs are counted: two sets that link share an n-gram among the first
``floor((1 - t) * |x|) + 1`` of either in the global order, and at the first one they share, what
both have passed doesn't exceed ``(1 - t) / (1 + t) * (|x| + |y|)``, the most in which they may
differ. So a set gives out its n-grams of the first fragment, and of the next ones only if it has
too few there. N-grams of one set only can't be shared, so of every set little is left to be matched.

Components need not every link. First the members of an n-gram's group are held against a few of
them, those of the greatest names, on which groups with many members in common mostly agree. What
links becomes a component. Then those with the most links so far are held against members of other
components, and at last all members of different components against each other. Pairs that were
counted before aren't counted again. A bitmap of each set gives a lower bound of the difference, so
pairs that can't link are dropped inside the join. Identical sets are one node. Joins by n-gram read
both sides from a shuffle, so that Spark can split a group that many sets share.

Links are counted, or listed, within the components, since no link leaves one. A component's sets
are dealt into blocks by hash, and every two blocks meet in a worker, which counts what each set of
one shares with each of the other. No set is left out and no row is made per pair but for the list.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabulon.llm import _words
from tabulon.llm._store import Scratch, map_arrow
from tabulon.llm.components import connected_components

BITMAP_LONGS = 8
#: How many members of a group are held against all others before the rest are, one of each slot by hash.
HUBS = 8
#: Rows of ids and names up to so many are broadcast (32 bytes each and the id); beyond, the join shuffles.
BROADCAST_IDS = 100_000
#: Sets, and n-grams, that a block of a component has on average.
BLOCK_SETS = 128
BLOCK_TOKENS = 1 << 18
#: Sets that a task remembers to have given out.
SEEN = 200_000
#: Rounding slack of comparisons with a bound computed in floating point.
SLACK = 1e-9

_BITMAP = [f"m{k}" for k in range(BITMAP_LONGS)]


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in (part for whole in batches for part in _words.parts(whole)):
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        yield batch, [_words.shingles(w.hashes, n) for w in _words.words(texts, lower=True)]


def _fingerprints(s: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart."""
    pair = [_words.mix(s + np.uint64(salt)).sum(dtype=np.uint64) for salt in (1, 2)]
    a, b = _words.mix(np.array(pair, dtype=np.uint64) + np.uint64(len(s))).view(np.int64)
    return int(a), int(b)


def _bitmap(s: np.ndarray) -> np.ndarray:
    """Parity of the n-grams that fall on each bit: two bitmaps differ in no more bits than the sets in n-grams."""
    bits = np.bincount((s & np.uint64(64 * BITMAP_LONGS - 1)).astype(np.int64), minlength=64 * BITMAP_LONGS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def _fragment(tokens: np.ndarray, fragments: int) -> np.ndarray:
    return (tokens >> np.uint64(33)) % np.uint64(fragments)


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(arrays) if arrays else [], kind))


def _given_out(s: np.ndarray, fragments: int, threshold: float) -> tuple[np.ndarray, list[int]]:
    """The n-grams of as many fragments as hold the set's prefix, and how many there are up to each of these."""
    need = int((1 - threshold) * len(s) + SLACK) + 1
    frag = _fragment(s, fragments)
    upto = np.cumsum(np.bincount(frag.astype(np.int64), minlength=fragments))
    last = int(np.searchsorted(upto, need))
    return s[frag <= np.uint64(last)], upto[: last + 1].tolist()


def _describe(n: int, fragments: int, threshold: float):
    none = np.zeros(0, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch, sets in _sets(batches, n):
            maps, names, tokens, upto = np.zeros((len(sets), BITMAP_LONGS), np.int64), [], [], []
            for k, s in enumerate(sets):
                name = _fingerprints(s) if len(s) else (0, 0)
                names.append(name)
                if not len(s) or name in seen:  # a copy that the task has given out
                    tokens.append(none)
                    upto.append([])
                    continue
                if len(seen) < SEEN:  # a bound on memory; what repeats beyond it is dropped after the shuffle
                    seen.add(name)
                maps[k] = _bitmap(s)
                out, sizes = _given_out(s, fragments, threshold)
                tokens.append(out.view(np.int64))
                upto.append(sizes)
            cols = [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64())]
            cols += [pa.array([x[i] for x in names], pa.int64()) for i in (0, 1)]
            cols += [pa.array(maps[:, k]) for k in range(BITMAP_LONGS)]
            cols += [_lists(upto, pa.int32()), _lists(tokens, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n", "fp", "fp2", *_BITMAP, "upto", "tokens"])

    return run


def _segments(n: int, fragments: int):
    """(node, frag, tokens) of each text whose fingerprints are the node's: a repeated id may have other texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _sets(batches, n):
            nodes, frags, segs = [], [], []
            for s, node, fp, fp2 in zip(sets, *(batch.column(c).to_pylist() for c in ("node", "fp", "fp2")), strict=True):
                if _fingerprints(s) != (fp, fp2):
                    continue
                f = _fragment(s, fragments)
                for k in range(fragments):
                    nodes.append(node)
                    frags.append(k)
                    segs.append(s[f == k].view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(frags, pa.int32()), _lists(segs, pa.int64())], ["node", "frag", "tokens"])

    return run


def _most_apart(t: float, a: Column, b: Column) -> Column:
    """The largest symmetric difference at which sets of these sizes still link."""
    return F.floor((1 - t) / (1 + t) * (a + b) + SLACK)


def _may_link(t: float, x: str, y: str) -> Column:
    """What sizes, positions and bitmaps of two prefix rows allow."""
    nx, ny = F.col(f"{x}.n"), F.col(f"{y}.n")
    differ = sum((F.bit_count(F.col(f"{x}.{m}").bitwiseXOR(F.col(f"{y}.{m}"))) for m in _BITMAP), F.lit(0))
    sizes = (F.least(nx, ny) >= t * F.greatest(nx, ny) - SLACK) & (F.col(f"{x}.pos") + F.col(f"{y}.pos") <= _most_apart(t, nx, ny))
    return sizes & (differ <= _most_apart(t, nx, ny))


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, fp, fp2, text) of the texts of the representatives (node, rep, fp, fp2), of which there are few or many."""
    few = wanted.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(wanted) if few else wanted, docs["doc_id"] == wanted["rep"]).select("node", "fp", "fp2", "text")


def _verified(work: Scratch, pairs: DataFrame, docs: DataFrame, nodes: DataFrame, n: int, fragments: int, t: float) -> DataFrame:
    """The pairs (a, b) of nodes that link, of a written table: partial overlaps by fragment, summed per pair."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = work.saved(ends.join(nodes.select("node", "rep", "fp", "fp2"), "node"), "wanted")
    segs = map_arrow(_texts_of(docs, wanted), _segments(n, fragments), "node long, frag int, tokens array<long>")
    segs = work.saved(segs, "segments")
    spread = pairs.select("a", "b", F.explode(F.sequence(F.lit(0), F.lit(fragments - 1))).alias("frag"))
    left = segs.select(F.col("node").alias("a"), "frag", F.col("tokens").alias("ta"))
    right = segs.select(F.col("node").alias("b"), "frag", F.col("tokens").alias("tb"))
    partial = spread.join(left, ["a", "frag"]).join(right, ["b", "frag"]).select(
        "a", "b", "frag", F.size(F.array_intersect("ta", "tb")).alias("part"), (F.size("ta") + F.size("tb")).alias("both")
    ).distinct()  # a repeated row of ``docs`` gives a segment twice
    total = partial.groupBy("a", "b").agg(F.sum("part").alias("common"), F.sum("both").alias("sizes"))
    t100 = round(t * 10_000)
    return work.saved(total.filter(F.col("common") * 10_000 >= F.lit(t100) * (F.col("sizes") - F.col("common"))).select("a", "b"), "links")


def _named(work: Scratch, grouped: DataFrame, name_bits: int) -> DataFrame:
    """The sets with ``node``, a 64-bit name of their own: their first fingerprint, but where several share it."""
    name = F.col("fp") if name_bits == 64 else F.pmod("fp", F.lit(1 << name_bits))
    nodes = work.saved(grouped.withColumn("node", name), "nodes")
    clash = nodes.groupBy("node").count().filter("count > 1").select("node")
    if clash.isEmpty():
        return nodes
    clash = work.saved(clash, "clashes")
    for salt in range(16):
        anew = nodes.join(clash, "node", "left_semi").withColumn("node", F.xxhash64(F.lit(salt), "fp", "fp2"))
        named = work.saved(nodes.join(clash, "node", "left_anti").unionByName(anew), "nodes")
        if named.groupBy("node").count().filter("count > 1").isEmpty():
            return named
    raise RuntimeError("sets share their names under every salt")


def _components(work: Scratch, docs: DataFrame, n: int, threshold: float, fragments: int, name_bits: int = 64) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, n, fp, fp2), nodes (node, rep, copies, n, fp, fp2) and (node, fp, fp2, component, component_id)."""
    docs = docs.select("doc_id", "text")
    schema = "doc_id {}, n long, fp long, fp2 long, {}, upto array<int>, tokens array<long>".format(dict(docs.dtypes)["doc_id"], ", ".join(f"{m} long" for m in _BITMAP))
    sets = work.saved(map_arrow(docs, _describe(n, fragments, threshold), schema), "sets")
    grouped = sets.filter("n > 0").groupBy("fp", "fp2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.min("n").alias("n"), F.max("n").alias("_most"), F.max(F.struct(F.size("upto").alias("k"), *_BITMAP, "upto", "tokens")).alias("s"))
    same = F.when(F.col("n") == F.col("_most"), F.col("n")).otherwise(F.raise_error(F.lit("two sets share 128 bits of fingerprints")).cast("long"))
    nodes = _named(work, grouped.select("fp", "fp2", "rep", "copies", same.alias("n"), *[f"s.{m}" for m in _BITMAP], "s.upto", "s.tokens"), name_bits)

    posts = nodes.filter("rep is not null").select("node", F.explode("tokens").alias("token"))
    shared = work.saved(posts.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1"), "shared")
    frag = F.pmod(F.shiftrightunsigned("token", 33), F.lit(fragments)).cast("int")
    counted = posts.join(shared, "token").withColumn("frag", frag).join(nodes.select("node", "n", "upto"), "node")
    order = Window.partitionBy("node", "frag")
    pos = F.get("upto", F.col("frag")) - F.count("*").over(order) + F.row_number().over(order.orderBy("df", "token")) - 1
    prefix = counted.withColumn("pos", pos).filter(F.col("pos") <= F.floor((1 - threshold) * F.col("n") + SLACK)).select("token", "node", "pos")
    prefix = work.saved(prefix.join(nodes.select("node", "n", *_BITMAP), "node"), "prefixes")

    def chosen(rows: DataFrame, best: Column) -> DataFrame:
        """A few members of each n-gram's group: of each slot by hash, the one with the greatest struct."""
        return rows.groupBy("token", F.pmod("node", F.lit(HUBS)).alias("slot")).agg(F.max(best).alias("h")).select("token", "h.*")

    def held_against(hubs: DataFrame, rows: DataFrame, settled: bool, before: list[DataFrame]) -> DataFrame:
        """Pairs (a, b) of a hub and another member of an n-gram's group that may link, not counted before,
        and in different components if some are ``settled``."""
        apart = F.col("x.node") != F.col("y.node") if hubs is not rows else F.col("x.node") < F.col("y.node")
        if settled:
            apart = apart & (F.col("x.comp") != F.col("y.comp"))
        pairs = rows.alias("y").join(hubs.alias("x"), (F.col("x.token") == F.col("y.token")) & apart & _may_link(threshold, "x", "y"))
        pairs = pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
        for b in before:
            pairs = pairs.join(b, ["a", "b"], "left_anti")
        return work.saved(pairs, "pairs")

    def with_components(comps: DataFrame) -> DataFrame:
        own = prefix.join(comps, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
        return work.saved(own, "prefixes")

    carried = ["node", "pos", "n", *_BITMAP]
    hubs = chosen(prefix, F.struct(*carried))
    tried = [held_against(hubs, prefix, False, [])]
    links = _verified(work, tried[0], docs, nodes, n, fragments, threshold)

    # Whoever has the same least neighbour is connected; that is enough to begin with.
    near = links.unionAll(links.select("b", "a")).groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("component"), F.count("*").alias("degree"))
    rows = with_components(near)
    hubs = chosen(rows.filter("degree is not null"), F.struct("degree", *carried, "comp")).drop("degree")
    tried.append(held_against(hubs, rows, True, tried))
    if not tried[1].isEmpty():
        links = links.unionByName(_verified(work, tried[1], docs, nodes, n, fragments, threshold))

    comps = work.saved(connected_components(work, links, "a", "b"), "components")
    rows = with_components(comps)
    mixed = work.saved(rows.groupBy("token").agg(F.min("comp").alias("_l"), F.max("comp").alias("_h")).filter("_l < _h").select("token"), "mixed")
    rest = work.saved(rows.join(mixed, "token", "left_semi"), "unsettled")
    tried.append(held_against(rest, rest, True, tried))
    if not tried[2].isEmpty():
        more = _verified(work, tried[2], docs, nodes, n, fragments, threshold)
        if not more.isEmpty():
            comps = connected_components(work, comps.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more), "a", "b")

    named = work.saved(nodes.select("node", "rep", "fp", "fp2").join(comps, "node", "left").withColumn("component", F.coalesce("component", "node")), "members")
    least = work.saved(named.groupBy("component").agg(F.min("rep").alias("component_id")), "least")
    return sets.select("doc_id", "n", "fp", "fp2"), nodes, named.join(least, "component").select("node", "fp", "fp2", "component", "component_id")


def _blocks_met(t: float, pairs: bool):
    """What links among the rows (component, i, j, side, node, copies, tokens), sorted by the first three:
    (node, links), or with ``pairs`` (a, b, common). Rows of side 0 meet those of side 1, or where i = j each other."""
    t100 = round(t * 10_000)

    def met(rows: dict[int, tuple[int, int, np.ndarray]], alone: bool) -> pa.RecordBatch | None:
        members = sorted(rows.items(), key=lambda x: x[1][0])
        names = np.array([k for k, _ in members], dtype=np.int64)
        copies = np.array([r[1] for _, r in members], dtype=np.int64)
        size = np.array([len(r[2]) for _, r in members], dtype=np.int64)
        lefts = len(members) if alone else sum(r[0] == 0 for _, r in members)
        if len(members) < 2 or not 0 < lefts or (not alone and lefts == len(members)):
            return None
        known, tokens = np.unique(np.concatenate([r[2] for _, r in members]), return_inverse=True)
        ends = np.cumsum(size)
        starts, mark = ends - size, np.zeros(len(known), dtype=bool)
        links, out = np.zeros(len(members), dtype=np.int64), []
        for x in range(lefts):
            y = x + 1 if alone else lefts
            if y == len(members):
                break
            own = tokens[starts[x] : ends[x]]
            mark[own] = True
            common = np.add.reduceat(mark[tokens[starts[y] :]], starts[y:] - starts[y], dtype=np.int64)
            mark[own] = False
            linked = y + np.flatnonzero(common * 10_000 >= t100 * (size[x] + size[y:] - common))
            links[x] += copies[linked].sum()
            links[linked] += copies[x]
            if pairs and len(linked):
                out.append((np.full(len(linked), names[x]), names[linked], common[linked - y]))
        if pairs:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["a", "b", "common"]) if out else None
        some = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays([pa.array(names[some]), pa.array(links[some])], ["node", "links"]) if len(some) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, {}
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("component", "i", "j")), strict=True))
            side, node, copies = (batch.column(c).to_pylist() for c in ("side", "node", "copies"))
            tokens = batch.column("tokens")
            for r, key in enumerate(keys):
                if key != at:
                    if rows and (got := met(rows, at[1] == at[2])) is not None:
                        yield got
                    at, rows = key, {}
                if node[r] not in rows:  # a repeated row of ``docs`` gives a set twice
                    rows[node[r]] = (side[r], copies[r], np.array(tokens[r].values))
        if rows and (got := met(rows, at[1] == at[2])) is not None:
            yield got

    return run


def _links(work: Scratch, docs: DataFrame, nodes: DataFrame, of_node: DataFrame, n: int, t: float, pairs: bool) -> DataFrame:
    """(node, links) or (a, b, common) of all links between distinct sets."""
    named = of_node.join(nodes.select("node", "rep", "copies", "n"), "node").filter("rep is not null")
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK_SETS, F.sum("n") / BLOCK_TOKENS)).cast("int").alias("blocks")
    several = work.saved(named.groupBy("component").agg(F.count("*").alias("_k"), blocks).filter("_k > 1").drop("_k"), "several")
    dealt = named.join(several, "component").select("node", "rep", "fp", "fp2", "copies", "component", "blocks", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("block"))
    dealt = work.saved(dealt, "blocks")
    texts = _texts_of(docs.select("doc_id", "text"), dealt.select("node", "rep", "fp", "fp2"))
    whole = map_arrow(texts, _segments(n, 1), "node long, frag int, tokens array<long>").drop("frag")
    each = whole.join(dealt.drop("rep", "fp", "fp2"), "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    i, j = F.least("block", "other"), F.greatest("block", "other")
    keys = ["component", "i", "j"]
    each = each.select("component", i.alias("i"), j.alias("j"), (F.col("block") > F.col("other")).cast("int").alias("side"), "node", "copies", "tokens")
    each = each.repartition(*keys).sortWithinPartitions(*keys)
    return map_arrow(each, _blocks_met(t, pairs), "a long, b long, common long" if pairs else "node long, links long")


def jaccard_components(docs: DataFrame, n: int = 3, threshold: float = 0.9, fragments: int = 4, name_bits: int = 64) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    Texts are taken whole, A-Z lower-cased; a text of fewer than ``n`` words is one shingle; one
    without words, or a null, has none, links with nothing and is its own component. Sets link
    when their Jaccard similarity is at least ``threshold`` (given to four decimals). The
    component is the smallest doc_id reachable by links. Rows that repeat a doc_id are one node
    if their sets are equal, else each has its own row and component. A row whose doc_id is null
    has a component through an equal set only, else null. Other columns aren't read; an empty
    table gives an empty result. ``name_bits`` narrows the names of sets, to test names that clash.
    """
    work = Scratch(docs.sparkSession, "op5")
    sets, _, of_node = _components(work, docs, n, threshold, fragments, name_bits)
    out = sets.join(of_node, ["fp", "fp2"], "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return work.result(out, "op5-components")


def jaccard_links(docs: DataFrame, n: int = 3, threshold: float = 0.9, fragments: int = 4) -> DataFrame:
    """The rows of ``jaccard_components`` with two more columns: class_id, n_links.

    The class of a row is the rows with an equal set, named by their smallest doc_id. ``n_links``
    is the number of other rows whose sets link with the row's: those of its class, and all rows
    of each class that links with it. Every link between different sets is counted. Rows without
    words link with nothing and are their own class. Sets that only rows with a null doc_id have
    link within their class alone.
    """
    work = Scratch(docs.sparkSession, "op5")
    sets, nodes, of_node = _components(work, docs, n, threshold, fragments)
    links = _links(work, docs, nodes, of_node, n, threshold, False).groupBy("node").agg(F.sum("links").alias("links"))
    of_class = of_node.drop("component").join(nodes.select("node", "rep", "copies"), "node").join(links, "node", "left")
    out = sets.join(work.saved(of_class, "classes"), ["fp", "fp2"], "left")
    n_links = F.coalesce(F.col("copies") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).cast("long")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("rep", "doc_id").alias("class_id"), n_links.alias("n_links"))
    return work.result(out, "op5-links")


def jaccard_pairs(docs: DataFrame, n: int = 3, threshold: float = 0.9, fragments: int = 4) -> DataFrame:
    """(class_a, class_b, common) of every link between different sets, class_a being the smaller name, and
    how many shingles they share. ``jaccard_links`` tells each row's class. A family of k sets has up to
    k * (k - 1) / 2 links."""
    work = Scratch(docs.sparkSession, "op5")
    _, nodes, of_node = _components(work, docs, n, threshold, fragments)
    pairs = _links(work, docs, nodes, of_node, n, threshold, True)
    for side in ("a", "b"):
        pairs = pairs.join(nodes.select(F.col("node").alias(side), F.col("rep").alias(f"_{side}")), side)
    return work.result(pairs.select(F.least("_a", "_b").alias("class_a"), F.greatest("_a", "_b").alias("class_b"), "common"), "op5-pairs")


def keep_one(docs: DataFrame, n: int = 5, threshold: float = 0.8, fragments: int = 3) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose id names their component."""
    kept = jaccard_components(docs, n, threshold, fragments).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_kept_id")).distinct()
    few = kept.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(kept) if few else kept, docs["doc_id"].eqNullSafe(kept["_kept_id"]), "left_semi")
