"""Near duplicates by SuperMinHash: signatures, banding, verification on full sets, union-find.

Signature: element x has an affine permutation of the m slots (m prime), slot(j) = a*j + b mod m,
and a fresh random r for each rank j; slot(j) takes the least j + r over the elements. A later
rank never beats an earlier one, so a document stops at the first rank at which all its slots
are taken. Affine permutations of a prime size spread any two ranks evenly over distinct slot
pairs, which is all that the estimate's variance depends on.

Grouping: texts with equal shingle sets are one class. Classes that agree in a whole band share
a bucket. Shingles that only one member of any bucket holds bound what a class can share with
others, and so does what both share with one pivot: after the first round, pairs that these
bounds rule out are not compared, which loses nothing. In each bucket
all members are compared with one pivot, the one of the fewest such shingles (the same class in
most of its buckets), not with each other; verified links join components. Small buckets that still hold
several components then compare all pairs between them; larger ones get further pivots, those
of most links first and sixteen times as many each round, until each is of one component or all
its pairs of different components have been compared. So groups of copies cost pairs in
proportion to their size, and no candidate pair is lost.
With 24 bands of 4 rows a link of similarity 0.85 is missed once in 5 * 10**7.

Defined results: a null or empty text has an empty set and is linked with nothing; a text of
fewer words than a shingle has one shingle of all its words; repeated rows are of one class;
rows that share a doc_id but not a text are linked apart, yet bear one component_id where both
lead theirs (drop_duplicates keeps one of them, unless the id is null); a null doc_id is in its
class but is never the smallest id, unless all are null; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .textcore import U64, Words, argsort64, mix64, shingles, text_slices

SLOTS, BANDS, ROWS, SHINGLE = 97, 24, 4, 5
#: In buckets of so many classes at most, all pairs of different components are compared after
#: the first round; larger ones go on with pivots.
SMALL_BUCKET = 64


def distinct_shingles(words: Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, first): distinct shingles sorted within each row, where each row begins."""
    h, doc = shingles(words, k)
    if not len(h):
        return h, doc, np.zeros(words.rows + 1, np.int64)
    bits = max(1, words.rows.bit_length())
    at = argsort64((doc.astype(U64) << U64(64 - bits)) | (h >> U64(bits)))
    h, doc = h[at], doc[at]
    if bits > 20:  # very many tiny texts: few bits are left for the hash
        at = np.lexsort((h, doc))
        h, doc = h[at], doc[at]
    new = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]
    h, doc = h[new], doc[new]
    return h, doc, np.searchsorted(doc, np.arange(words.rows + 1))


def superminhash(h: np.ndarray, doc: np.ndarray, rows: int, slots: int = SLOTS) -> np.ndarray:
    """rows x slots signatures of 64-bit values rank * 2**32 + r."""
    m = slots
    sig = np.full(rows * m, np.iinfo(U64).max, U64)
    free = np.ones(rows * m, bool)
    left = np.full(rows, m)
    step = (h >> U64(33)).astype(np.int64) % (m - 1) + 1
    at = (h & U64(0xFFFFFFFF)).astype(np.int64) % m
    base = doc * m
    for rank in range(m):
        place = base + at
        hit = np.flatnonzero(free[place])
        where = place[hit]
        with np.errstate(over="ignore"):
            r = mix64(h[hit] + U64((rank + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> U64(32)
        np.minimum.at(sig, where, r | U64(rank << 32))
        taken = np.unique(where) if len(where) < 4096 else np.flatnonzero(np.bincount(where, minlength=0))
        free[taken] = False
        left -= np.bincount(taken // m, minlength=rows)
        go = left[doc] > 0
        if not go.any():
            break
        if not go.all():
            h, doc, step, at, base = h[go], doc[go], step[go], at[go], base[go]
        at = (at + step) % m
    return sig.reshape(rows, m)


def band_keys(sig: np.ndarray, bands: int = BANDS, per: int = ROWS) -> np.ndarray:
    out = np.zeros((len(sig), bands), U64)
    with np.errstate(over="ignore"):
        for b in range(bands):
            key = np.full(len(sig), U64(b + 1))
            for j in range(per):
                key = mix64(key * U64(0x9E3779B97F4A7C15) + sig[:, b * per + j])
            out[:, b] = key
    return out.view(np.int64)


def set_ids(h: np.ndarray, first: np.ndarray) -> list[bytes]:
    """128 bits that stand for each row's set."""
    n = np.diff(first)
    out = np.zeros((len(n), 2), U64)
    full = np.flatnonzero(n)
    with np.errstate(over="ignore"):
        for i, salt in enumerate((0xA0761D6478BD642F, 0x8EBC6AF09C88C6E3)):
            if len(full):
                out[full, i] = mix64(np.add.reduceat(mix64(h ^ U64(salt)), first[:-1][full]) + n[full].astype(U64))
    return [x.tobytes() for x in out]


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, raw, offsets in text_slices(batch.column(1)):
            h, doc, first = distinct_shingles(Words(raw, offsets))
            keys = band_keys(superminhash(h, doc, b - a))
            bands = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), pa.array(keys.ravel()))
            yield pa.record_batch([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(np.diff(first)), pa.array(set_ids(h, first), pa.binary()), bands], ["doc_id", "_text_key", "n_shingles", "set_id", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, raw, offsets in text_slices(batch.column(1)):
            h, _, first = distinct_shingles(Words(raw, offsets))
            found = set_ids(h, first)
            want = batch.column(2).slice(a, b - a).to_pylist()
            nodes = batch.column(0).slice(a, b - a).to_pylist()
            keep = [i for i in range(b - a) if found[i] == want[i]]
            yield pa.record_batch([pa.array([nodes[i] for i in keep], pa.int64()), pa.array([h[first[i] : first[i + 1]].tobytes() for i in keep], pa.binary())], ["node", "items"])


def _item_blocks(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(shingle, holder) blocks by shingle range; -1 stands for several holders."""
        for batch in batches:
            nodes = batch.column(0).to_numpy()
            parts = [np.frombuffer(x.as_buffer(), U64) for x in batch.column(1)]
            items = np.concatenate(parts) if parts else np.empty(0, U64)
            if not len(items):
                continue
            holder = np.repeat(nodes, [len(p) for p in parts])
            at = argsort64(items)
            items, holder = items[at], holder[at]
            edge = np.flatnonzero(np.r_[True, items[1:] != items[:-1]])
            several = np.diff(np.r_[edge, len(items)]) > 1
            items, holder = items[edge], np.where(several, -1, holder[edge])
            shard = (items >> U64(64 - bits)).astype(np.int32)
            begin = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
            blocks = [items[a:z].tobytes() + holder[a:z].tobytes() for a, z in zip(begin, [*begin[1:], len(items)])]
            yield pa.record_batch([pa.array(shard[begin]), pa.array(blocks, pa.binary())], ["shard", "block"])

    return run


def _single_holders(pdf: pd.DataFrame) -> pd.DataFrame:
    """(node, singles) of one range: how many shingles of it only this node holds."""
    items = np.concatenate([np.frombuffer(b, U64, len(b) // 16) for b in pdf["block"]])
    holder = np.concatenate([np.frombuffer(b, np.int64, len(b) // 16, len(b) // 2) for b in pdf["block"]])
    at = argsort64(items)
    items, holder = items[at], holder[at]
    edge = np.flatnonzero(np.r_[True, items[1:] != items[:-1]])
    alone = holder[edge][np.diff(np.r_[edge, len(items)]) == 1]
    node, n = np.unique(alone[alone >= 0], return_counts=True)
    return pd.DataFrame({"node": node, "singles": n.astype(np.int64)})


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, left, right = (batch.column(i) for i in range(4))
            shared, linked, last, other = [], [], None, None
            for i in range(batch.num_rows):
                mine = np.frombuffer(left[i].as_buffer(), U64)
                if b[i] != last:
                    last, other = b[i], np.frombuffer(right[i].as_buffer(), U64)
                n = len(mine) + len(other)
                at = np.minimum(np.searchsorted(other, mine), len(other) - 1)
                both = int(np.count_nonzero(other[at] == mine))
                shared.append(both)
                linked.append(100 * both >= percent * (n - both))
            yield pa.record_batch([a, b, pa.array(shared, pa.int64()), pa.array(linked, pa.bool_())], ["a", "b", "hits", "linked"])

    return run


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union-find over one partition's edges: each node with its root (the least node)."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = parent[x]
        return x

    for pdf in batches:
        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = [(x, root(x)) for x in list(parent)]
    yield pd.DataFrame([x for x in nodes if x[0] != x[1]], columns=["a", "b"], dtype="int64")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): connected components with the least node as root, for all nodes with an
    edge (a, b). Partitions fold their edges by union-find; large-star and small-star steps
    then link the forests across partitions, until all links lead straight to roots."""
    now = common.written(edges.mapInPandas(_forest, "a long, b long"), "forest")
    while True:
        ends = now.select("a", F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(now.select(F.col("b").alias("a"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        seen = ends.groupBy("a").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        state = seen.agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.expr("up > 1 or (up = 1 and down = 1)")).alias("astray")).first()
        if not state["astray"]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        # no step adds a node; what is sent is not written before
        near = 32 * state["nodes"] <= common.BROADCAST_BYTES
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # a root has as many links as its component has nodes: they are not dealt by root where a broadcast does
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        least = F.broadcast(least) if near else common.written(least, "least")
        large = common.written(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b"), "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        least = least if near else common.written(least, "least")
        small = large.join(F.broadcast(least) if near else least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        now = common.written(small.where("a <> b").distinct(), "stars")


def group(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    return _grouped(docs, percent).drop("_text_key", "_lead")


def _grouped(docs: DataFrame, percent: int) -> DataFrame:
    texts = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    signed = common.written(texts.withColumn("_text_key", F.xxhash64("text")).mapInArrow(_sign, f"doc_id {kind}, _text_key long, n_shingles long, set_id binary, bands array<long>"), "signed")
    classes = signed.where("n_shingles > 0").groupBy("set_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_text_key")).alias("one"), F.max("n_shingles").alias("n_items"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("rows"))
    # many rows may share an id, so a class is led by a row's id and text
    classes = classes.withColumns({"rep": F.col("one.doc_id"), "rep_key": F.col("one._text_key")})
    classes = common.written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    banded = classes.select("node", F.explode("bands").alias("key"))
    shared = common.written(banded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "shared")
    held = common.measure(shared)
    if held["n"]:
        # a large group of near copies shares its keys: they are not dealt by key where a broadcast does
        members = common.written(banded.join(common.small(shared, held["bytes"]), "key"), "members")
        links, bound = _links(texts, classes, members, percent)
        joined = classes.select("node", "one", "set_id").join(common.small(links, bound), "node", "left").select("one", "set_id", F.coalesce("root", "node").alias("root"))
        least = common.written(joined.groupBy("root").agg(F.min("one").alias("lead")), "least")
        rooted = joined.join(common.small(least), "root").select("set_id", "lead")
    else:
        rooted = classes.select("set_id", F.col("one").alias("lead"))
    rooted = common.written(rooted.select("set_id", F.col("lead.doc_id").alias("component_id"), F.col("lead._text_key").alias("_lead")), "rooted")
    # texts without words have no class, and the many copies of one text are not dealt to one task
    names = ["doc_id", "_text_key", "n_shingles"]
    some = common.attach(signed.where("n_shingles > 0").select(*names, "set_id"), rooted, ["set_id"], classes.where(F.col("rows") > common.HOT_ROWS))
    none = signed.where("n_shingles = 0").select(*names, F.col("doc_id").alias("component_id"), F.col("_text_key").alias("_lead"))
    out = some.select(*names, "component_id", "_lead").unionByName(none)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _links(texts: DataFrame, classes: DataFrame, members: DataFrame, percent: int) -> tuple[DataFrame, int]:
    """(node, root) of the classes that have links, and bytes that these do not exceed."""
    needed = members.select("node").distinct().join(classes.select("node", "rep", "rep_key", "set_id", "n_items"), "node")
    needed = common.written(needed, "needed")
    # rows of these classes and of no more columns than here are no larger: one measure serves them all
    size = common.measure(needed, F.sum("n_items").alias("items"))
    bound = size["bytes"]
    side = common.small(needed, bound)
    texts = texts.withColumn("_text_key", F.xxhash64("text"))
    sets = texts.join(side, texts["doc_id"].eqNullSafe(needed["rep"]) & (texts["_text_key"] == needed["rep_key"])).select("node", "text", "set_id")
    sets = common.written(sets.mapInArrow(_sets, "node long, items binary").dropDuplicates(["node"]), "sets")
    bits = min(30, max(6, ((size["items"] or 0) // 500_000).bit_length()))  # half a million shingles a range
    alone = sets.mapInArrow(_item_blocks(bits), "shard int, block binary").groupBy("shard").applyInPandas(_single_holders, "node long, singles long")
    alone = alone.groupBy("node").agg(F.sum("singles").alias("singles"))
    sized = needed.select("node", "n_items").join(alone, "node", "left").select("node", "n_items", (F.col("n_items") - F.coalesce("singles", F.lit(0))).alias("common"))
    # what a class can share with any other must reach the threshold even against itself
    sized = common.written(sized.where(F.col("common") * 100 >= F.col("n_items") * percent), "sized")
    members = common.written(members.join(common.small(sized, bound), "node"), "members")
    # fewest single shingles first: share of singles in thousandths, then the node
    rank = (((F.col("n_items") - F.col("common")) * 1000 / F.col("n_items")).cast("long") * F.lit(1 << 50) + F.col("node")).alias("rank")
    members = members.withColumn("rank", rank)
    buckets = common.written(members.groupBy("key").agg(F.min("rank").alias("pivot_rank"), F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    held = common.measure(buckets, F.max("n").alias("largest"))
    members = common.written(members.join(common.small(buckets, held["bytes"]), "key").withColumn("pivot", F.col("pivot_rank") % F.lit(1 << 50)), "ranked")

    def possible() -> Column:
        """Whether bounds leave room for a link. Two classes share at most what each shares with
        any other; and of two with one reference, at most the lesser of what they share with it
        and the lesser of what else they share with any other."""
        most = F.least("common", "p_common")
        around = F.least("hits", "p_hits") + F.greatest(F.lit(0), F.least(F.col("common") - F.col("hits"), F.col("p_common") - F.col("p_hits")))
        most = F.when(F.col("ref") == F.col("p_ref"), F.least(most, around)).otherwise(most)
        return most * 100 >= (F.col("n_items") + F.col("p_items") - most) * percent

    def verified(pairs: DataFrame) -> DataFrame:
        left = pairs.join(sets.withColumnRenamed("items", "left"), pairs["a"] == sets["node"]).select("a", "b", "left")
        both = left.join(sets.withColumnRenamed("items", "right"), left["b"] == sets["node"]).select("a", "b", "left", "right")
        return both.mapInArrow(_verify(percent), "a long, b long, hits long, linked boolean")

    pairs = members.where("node <> pivot").select("node", "pivot", "pivot_rank").distinct()
    first = common.written(pairs, "pairs")
    compared = first.select(F.greatest("node", "pivot").alias("a"), F.least("node", "pivot").alias("b")).distinct()
    seen = common.written(verified(compared), "verified")
    edges = seen.where("linked").select("a", "b")
    links = components(edges)
    # each class's reference: of its pivots the one that ranks first, or itself where it ranks before them
    told = first.join(seen, (F.col("a") == F.greatest("node", "pivot")) & (F.col("b") == F.least("node", "pivot"))).select("node", F.struct("pivot_rank", F.col("pivot").alias("ref"), "hits").alias("r"))
    itself = members.where("node = pivot").select("node", F.struct("pivot_rank", F.col("pivot").alias("ref"), F.col("n_items").alias("hits")).alias("r")).distinct()
    refs = told.unionByName(itself).groupBy("node").agg(F.min("r").alias("r"))
    sized = common.written(sized.join(refs, "node").select("node", "n_items", "common", "r.ref", "r.hits"), "referenced")
    pivots = members.select("key", F.col("pivot").alias("node")).distinct()
    as_pivot = {"node": "pivot", "root": "pivot_root", "n_items": "p_items", "common": "p_common", "ref": "p_ref", "hits": "p_hits", "bands": "p_bands"}
    more = 0
    while (held["largest"] or 0) > (2 if more == 0 else SMALL_BUCKET):
        named = members.where("n > 2" if more == 0 else f"n > {SMALL_BUCKET}").select("key", "node", "n").join(common.small(links, bound), "node", "left").withColumn("root", F.coalesce("root", "node"))
        live = common.written(named.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("key"), "live")
        open_ = named.join(common.small(live, held["bytes"]), "key").select("key", "node", "root", "n").join(common.small(sized, bound), "node")
        open_ = common.written(open_.join(classes.select("node", "bands"), "node"), "open")
        # small buckets: every member is a pivot now; others: members of most links, one from each of `more` parts
        fresh = open_.join(pivots, ["key", "node"], "left_anti")
        chosen = fresh.where(f"n <= {SMALL_BUCKET}").select("key", *[F.col(c).alias(p) for c, p in as_pivot.items()]) if more == 0 else None
        more = 256 if more == 0 else 16 * more
        degree = edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("links"))
        best = fresh.where(f"n > {SMALL_BUCKET}").join(degree, "node", "left").groupBy("key", F.pmod(F.xxhash64("node", F.lit(more)), F.lit(more)).alias("part")).agg(F.max(F.struct(F.coalesce("links", F.lit(0)).alias("links"), *as_pivot)).alias("best"))
        best = best.select("key", *[F.col(f"best.{c}").alias(p) for c, p in as_pivot.items()])
        chosen = common.written(best if chosen is None else chosen.unionByName(best), "pivots")
        taken = common.measure(chosen)
        if not taken["n"]:
            break
        pivots = pivots.unionByName(chosen.select("key", F.col("pivot").alias("node")))
        # a pair is made once, in the least bucket that it shares
        once = F.array_min(F.array_intersect("bands", "p_bands")) == F.col("key")
        pairs = open_.join(common.small(chosen, taken["bytes"]), "key").where((F.col("root") != F.col("pivot_root")) & possible() & once)
        # a pair may have been compared in either direction
        pairs = pairs.select(F.greatest("node", "pivot").alias("a"), F.least("node", "pivot").alias("b")).distinct()
        pairs = common.written(pairs.join(compared, ["a", "b"], "left_anti"), "pairs")
        compared = compared.unionByName(pairs)
        found = common.written(verified(pairs).where("linked").select("a", "b"), "edges")
        edges = edges.unionByName(found)
        if not found.isEmpty():
            links = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(found))
    return links, bound


def drop_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """The rows to keep, with the input's columns: all rows without words, and one row of each
    component, that of the smallest doc_id. Of components whose doc_id is the same one stays, that of
    the least text key; of those without any doc_id each."""
    marked = common.written(_grouped(docs, percent), "grouped")
    id_key = common.fresh(docs.columns, "_id", "_key")
    named = marked.where("n_shingles > 0").withColumnsRenamed(dict(zip(("doc_id", "_text_key"), id_key)))
    leads = F.col(id_key[0]).eqNullSafe(F.col("component_id")) & (F.col(id_key[1]) == F.col("_lead"))
    heads = common.written(named.where(leads).groupBy(*id_key).agg(F.count(F.lit(1)).alias("_rows")), "heads")
    # different texts of one id are one document; null is no id
    rivals = heads.where(F.col(id_key[0]).isNotNull()).groupBy(id_key[0]).agg(F.min(id_key[1]).alias("_stay"), F.count(F.lit(1)).alias("_texts"))
    rivals = heads.join(common.small(common.written(rivals.where("_texts > 1"), "rivals")), id_key[0]).where(F.col(id_key[1]) != F.col("_stay"))
    gone = common.written(named.where(~leads).select(*id_key).distinct().unionByName(rivals.select(*id_key)), "gone")
    twice = common.written(heads.where("_rows > 1").select(*id_key), "repeated")
    same = F.col("doc_id").eqNullSafe(F.col(id_key[0])) & (F.xxhash64("text") == F.col(id_key[1]))
    out = docs.join(common.small(gone), same, "left_anti")
    again = common.measure(twice)
    if again["n"]:  # equal rows: one of each stays
        stay = common.small(twice, again["bytes"])
        out = out.join(stay, same, "left_anti").unionByName(out.join(stay, same, "left_semi").dropDuplicates(["doc_id", "text"]))
    return out
