r"""MinHash near-duplicates by a multi-index Hamming join of b-bit signatures.

A text's set is its distinct shingles of k words [^\x20\x09-\x0D]+ (A-Z lower-cased; fewer words: the
whole sequence; none: empty and linked with nothing). Texts of equal sets are one node. A signature
has LANES values of 16 bits; two signatures' distance is the number of lanes that differ. For sets of
similarity t a lane differs with probability 1 - t, so links lie within a radius of LANES * (1 - t)
plus 5.5 standard deviations (a miss is rarer than one in a million at t, and far rarer above it).

The join: lanes are split into (radius + 1) / 2 chunks, so a pair within the radius has a chunk with
at most one error (pigeonhole). Each node gets a key for each chunk and each place of an allowed
error, made of the chunk's other lanes; every pair within the radius shares a key. Links are confirmed
on the full sets. Only components are wanted, so groups of a key are resolved without listing their
pairs: first by stars (each member with the least, then with the greatest node), which confirms dense
groups in linear work; groups that still hold several components go, in blocks of bounded size, to
tasks that compare sets across components and return a forest.

Defined results: null texts count as empty; rows with a null id take part, their component is the
least id that it holds or null; repeated rows share a component; an empty table gives an empty table.
Of each component exactly one row is kept, of the least id (null last), whatever ids other rows have;
rows without shingles are all kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fonoteca.llm import common

LANES, SEED = 64, 3
#: What a block of an open group holds at most, about: members, and shingles (8 bytes each) of them.
BLOCK, BLOCK_SHINGLES = 4000, 1 << 20
_rng = np.random.default_rng(SEED)
FACTORS = _rng.integers(1, 2**63, LANES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _rng.integers(1, 2**63, LANES, dtype=np.uint64)
PLACES = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    import xxhash

    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    of = {w: xxhash.xxh3_64_intdigest(w) for w in set(words)}
    ids = np.array([of[w] for w in words], dtype=np.uint64)
    k = min(k, len(ids))
    whole = np.full(len(ids) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        whole = mixed(whole * PLACES[i] + ids[i : len(ids) - k + 1 + i])
    return np.unique(whole)


def signature(hashes: np.ndarray) -> bytes:
    least = np.full(LANES, 2**64 - 1, dtype=np.uint64)
    for i in range(0, len(hashes), 4096):
        part = hashes[i : i + 4096]
        np.minimum(least, (part[:, None] * FACTORS + SHIFTS).min(0), out=least)
    return (mixed(least) & np.uint64(0xFFFF)).astype("<u2").tobytes()


def radius(threshold: float) -> int:
    """The distance within which linked pairs lie."""
    p = 1 - threshold
    return math.ceil(LANES * p + 5.5 * math.sqrt(LANES * p * (1 - p)))


def chunks(r: int) -> list[np.ndarray]:
    return np.array_split(np.arange(LANES), (r + 2) // 2)


def keys_of(signatures: np.ndarray, r: int) -> np.ndarray:
    """A row of keys for each signature: for each chunk and each of its lanes, the chunk without it."""
    out = []
    for c, lanes in enumerate(chunks(r)):
        for wild in lanes:
            key = np.full(len(signatures), c * LANES + int(wild) + 1, dtype=np.uint64)
            for lane in lanes[lanes != wild]:
                key = mixed(key * PLACES[lane % 64] + signatures[:, lane].astype(np.uint64))
            out.append(key)
    return np.stack(out, 1).view(np.int64) if len(signatures) else np.zeros((0, LANES), dtype=np.int64)


def signed(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """id, tkey (a hash of the text), n_shingles, node (a hash of the set) and sig of every row."""
    import xxhash

    def make():
        def of(texts: list[bytes]) -> list[list]:
            sets = [shingles(t, k) for t in texts]
            return [[len(s) for s in sets], [xxhash.xxh3_128_digest(s.tobytes()) for s in sets], [signature(s) for s in sets]]

        return of

    text = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("tkey"), F.col(text_col).alias("t"))
    return common.map_texts(text, "t", ["id", "tkey"], "n_shingles long, node binary, sig binary", make)


def keyed(nodes: DataFrame, r: int) -> DataFrame:
    """(key, nid), a row for each key of each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 2000):
                batch = whole.slice(i, 2000)
                keys = keys_of(np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype="<u2").reshape(-1, LANES), r)
                nids = np.repeat(batch.column(0).to_numpy(), keys.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(nids)], names=["key", "nid"])

    return nodes.select("nid", "sig").mapInArrow(run, "key long, nid long")


def confirmed(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The edges (a, b) whose sets are similar; a, which many edges may share, is joined first."""
    one, other = sets.select(F.col("nid").alias("a"), F.col("hashes").alias("ha")), sets.select(F.col("nid").alias("b"), F.col("hashes").alias("hb"))
    both = F.size(F.array_intersect("ha", "hb")).cast("long")
    alike = edges.join(one, "a").where(F.col("ha").isNotNull()).join(other, "b").withColumn("both", both)
    return alike.where(100 * F.col("both") >= percent * (F.size("ha") + F.size("hb") - F.col("both"))).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(nid, comp): the least node of each component, by alternating large-star and small-star steps.

    Each step is a join with the least neighbour, aggregated before it is shuffled; the edges are
    written to shared storage after each pair of steps. It ends when they no longer change.
    """
    now = common.materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(least, "u")
        small = linked.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now = common.materialise(small)
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            return now.select(F.col("u").alias("nid"), F.col("v").alias("comp"))
        seen = mark


def towards(links: DataFrame) -> DataFrame:
    """(nid, comp): from each node along links to lesser ones, three links far at most.

    Nodes of one comp are in one component, though not all of a component may have one comp: enough to
    tell which comparisons are spared, in a few joins.
    """
    now = links.select(F.greatest("a", "b").alias("nid"), F.least("a", "b").alias("comp")).groupBy("nid").agg(F.min("comp").alias("comp"))
    far = now.select(F.col("nid").alias("comp"), F.col("comp").alias("next"))
    for _ in range(2):
        now = now.join(far, "comp", "left").select("nid", F.coalesce("next", "comp").alias("comp"))
    return now


def across(members: DataFrame, labels: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Members with their components, and the keys of at least so many members that hold several components."""
    now = members.join(labels, "nid", "left").withColumn("comp", F.coalesce("comp", "nid"))
    parts = now.groupBy("key", "comp").agg(F.count("*").alias("n"), F.max("nid").alias("last"), F.sum(F.xxhash64("nid").cast("decimal(38,0)")).alias("check"))
    keys = parts.groupBy("key").agg(F.sum("n").alias("m"), F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.max("last").alias("last"), F.sum("check").alias("check"))
    return now, keys.where((F.col("c0") != F.col("c1")) & (F.col("m") >= least)).select("key", "m", "c0", "last", "check")


def in_blocks(now: DataFrame, keys: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int, r: int) -> DataFrame:
    """Confirmed edges between components in the groups that stars left open.

    A block holds about BLOCK members, and about BLOCK_SHINGLES shingles, at most. A group that is no
    larger goes to one task as it is. In larger ones the members of the component of the group's least
    node, and the others, are each cut into blocks, and a task gets two blocks, not both of that
    component. It compares signatures, then sets, of members whose components are apart, joining those
    that it links.
    """
    groups = keys.dropDuplicates(["m", "check"]).select("key", "c0")
    of_c0, h = F.col("comp") == F.col("c0"), F.xxhash64("nid")
    placed = now.join(groups, "key").join(nodes.select("nid", "sig", "n_shingles"), "nid")

    def blocks(part: Column) -> Column:
        n, size = F.count(F.when(part, 1)), F.coalesce(F.sum(F.when(part, F.col("n_shingles"))), F.lit(0))
        return F.ceil(F.greatest(n / BLOCK, size / BLOCK_SHINGLES)).cast("int")

    cut = placed.groupBy("key").agg(blocks(F.lit(True)).alias("all"), blocks(of_c0).alias("own_blocks"), blocks(~of_c0).alias("more"))
    whole = F.col("all") == 1
    cut = cut.select("key", F.when(whole, 0).otherwise(F.col("own_blocks")).alias("own_blocks"), F.when(whole, 1).otherwise(F.col("more")).alias("more"))
    placed = placed.join(cut, "key")
    main = of_c0 & (F.col("own_blocks") > 0)
    placed = placed.withColumn("own", F.when(main, F.pmod(h, F.col("own_blocks"))).otherwise(F.col("own_blocks") + F.pmod(h, F.col("more"))).cast("int"))
    pairs = placed.withColumn("other", F.explode(F.sequence(F.when(main, F.col("own_blocks")).otherwise(0), F.col("own_blocks") + F.col("more") - 1)))
    pairs = pairs.select("key", "nid", "sig", "comp", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    rows = pairs.join(sets, "nid")

    def compare(table: pa.Table) -> pa.Table:
        common.give_up()
        _, at = np.unique(table.column("nid").to_numpy(), return_index=True)
        table = table.take(pa.array(at)).combine_chunks()
        nids, comp, own, i, j = (table.column(c).to_numpy() for c in ("nid", "comp", "own", "i", "j"))
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), dtype="<u2").reshape(-1, LANES)
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                x = parent[x] = parent.get(up, up)
            return x

        found: list[tuple[int, int]] = []
        sizes = pc.list_value_length(table.column("hashes")).to_numpy().astype(np.int64)
        begins = np.cumsum(sizes) - sizes
        known, ids = np.unique(pc.list_flatten(table.column("hashes")).to_numpy(), return_inverse=True)
        mark = np.zeros(len(known), dtype=np.int64)
        for x in range(len(nids) - 1):
            apart = (comp[x + 1 :] != comp[x]) & ((sig[x + 1 :] != sig[x]).sum(1) <= r)
            if i[0] != j[0]:
                apart &= own[x + 1 :] != own[x]
            if not apart.any():
                continue
            mine = ids[begins[x] : begins[x] + sizes[x]]
            mark[mine] = 1
            both = np.add.reduceat(mark[ids[begins[x + 1] :]], begins[x + 1 :] - begins[x + 1])
            mark[mine] = 0
            for y in (np.flatnonzero(apart & (100 * both >= percent * (sizes[x] + sizes[x + 1 :] - both))) + x + 1).tolist():
                p, q = root(int(comp[x])), root(int(comp[y]))
                if p != q:
                    parent[p] = q
                    found.append((int(nids[x]), int(nids[y])))
        return pa.table({c: pa.array([f[n] for f in found], pa.int64()) for n, c in enumerate("ab")})

    return rows.groupBy("key", "i", "j").applyInArrow(compare, "a long, b long")


def judged(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    """id, tkey, n_shingles, component, kept and spare of every row.

    Rows are told apart by uid, a number given when they are signed; spare: not kept, but equal in id
    and text to the row that is.
    """
    r = radius(percent / 100)
    marks = common.materialise(signed(docs, id_col, text_col, k).withColumn("uid", F.monotonically_increasing_id()))
    nodes = marks.where("n_shingles > 0").groupBy("node").agg(F.min("id").alias("least"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "tkey", "uid")).alias("rep"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n_shingles"))
    nodes = common.materialise(nodes.withColumn("nid", F.monotonically_increasing_id()))

    keys = keyed(nodes, r)
    shared = keys.groupBy("key").agg(F.count("*").alias("m"), F.min("nid").alias("first")).where("m > 1")
    members = common.materialise(keys.join(shared.select("key", "first"), "key"))
    wanted = members.select("nid").distinct().join(nodes, "nid").select("nid", "node", F.col("rep.id").alias("id"), F.col("rep.tkey").alias("tkey"))

    def make():
        def of(texts: list[bytes]) -> list[list]:
            return [[shingles(t, k).view(np.int64) for t in texts]]

        return of

    texts = docs.select(F.col(id_col).alias("doc"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("tkey"), F.col(text_col).alias("t"))
    wanted = wanted.hint("shuffle_hash")
    chosen = texts.join(wanted, (texts["tkey"] == wanted["tkey"]) & texts["doc"].eqNullSafe(wanted["id"])).select("nid", "t").dropDuplicates(["nid"])
    sets = common.materialise(common.map_texts(chosen, "t", ["nid"], "hashes array<long>", make))

    stars = members.where("nid <> first").select(F.col("first").alias("a"), F.col("nid").alias("b")).distinct()
    links = common.materialise(confirmed(stars, sets, percent))
    now, open_keys = across(members, towards(links), 3)
    stars = now.join(open_keys, "key").where("nid <> last").select(F.col("last").alias("a"), F.col("nid").alias("b")).distinct()
    links = common.materialise(links.unionByName(confirmed(stars, sets, percent)))
    labels = components(links)
    now, open_keys = across(members, labels, 4)
    more = in_blocks(now, open_keys, nodes, sets, percent, r)
    labels = components(labels.select(F.col("nid").alias("a"), F.col("comp").alias("b")).unionByName(more))

    named = nodes.select("node", "nid", "least", "rep").join(labels, "nid", "left").withColumn("comp", F.coalesce("comp", "nid"))
    least = named.groupBy("comp").agg(F.min("least").alias("component"), F.min("rep").alias("rep"))
    of_node = named.drop("rep").join(least, "comp").select("node", "component", "rep")
    full = marks.where("n_shingles > 0").join(of_node, "node")
    kept = F.col("uid") == F.col("rep.uid")
    spare = ~kept & F.col("id").eqNullSafe(F.col("rep.id")) & (F.col("tkey") == F.col("rep.tkey"))
    full = full.select("id", "tkey", "n_shingles", "component", kept.alias("kept"), spare.alias("spare"))
    bare = marks.where("n_shingles = 0").select("id", "tkey", "n_shingles", F.col("id").alias("component"), F.lit(True).alias("kept"), F.lit(False).alias("spare"))
    return full.unionByName(bare)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """id, n_shingles, component_id, kept of every row; links have 100 * common >= percent * joint shingles."""
    return judged(docs, id_col, text_col, k, percent).select(F.col("id").alias(id_col), "n_shingles", F.col("component").alias("component_id"), "kept")


@common.apart
def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """docs without all but one row of each component, with the columns of docs."""
    found = common.materialise(judged(docs, id_col, text_col, k, percent).where("not kept").select(F.col("id").alias("__id"), F.col("tkey").alias("__key"), "spare"))
    keyed_docs = docs.withColumn("__tkey", F.xxhash64(F.coalesce(text_col, F.lit(""))))

    def met(keys: DataFrame, how: str) -> DataFrame:
        return keyed_docs.join(keys, (keyed_docs["__tkey"] == keys["__key"]) & keyed_docs[id_col].eqNullSafe(keys["__id"]), how)

    gone, spare = found.where("not spare"), found.where("spare").select("__id", "__key").distinct()
    if spare.isEmpty():
        return met(gone.select("__id", "__key").distinct().hint("shuffle_hash"), "left_anti").select(*docs.columns)
    # Rows repeated as a whole stand for one row.
    stay = met(found.select("__id", "__key").distinct().hint("shuffle_hash"), "left_anti")
    once = met(spare.hint("shuffle_hash"), "left_semi").dropDuplicates([id_col, "__tkey"])
    return stay.unionByName(once).select(*docs.columns)
