"""Near-duplicate documents: SuperMinHash signatures, banding, verification, union-find.

The set of a document: the distinct `k`-word shingles of its lower-cased text (A-Z only); a shorter text is one
shingle.  Documents with equal sets form a class.  Classes are linked when 100 * |intersection| >= percent * |union|,
always confirmed on the full sets.

SuperMinHash (Ertl, 2017): every element walks a random permutation of the signature's slots; in step j it offers slot
p_j the value j + r.  Later steps can only offer larger values, so that a document is done as soon as all its slots
hold values of a finished step: one or two steps for ordinary texts.

Banding: `bands` keys of `rows` slots each.  With 28 x 4 a pair at 0.80 meets in no band with probability 4e-7, with
20 x 4 one at 0.85.

Pairs: not all pairs of a bucket are made.  Each member is compared with its bucket's hub (linear in the bucket), and
members linked with each other through hubs are done with.  A member that is not in its hub's component is `away`; a
pair is open if one of its two is away.  Where a bucket has few open pairs a member, they are made.  Else pairs
are searched by what tells members from their hub (buckets with hubs of one component become one before): for sets D and D' with hub H, D and D' differ as much as the deltas
D ^ H and D' ^ H do (^: symmetric difference), so that a link asks for deltas that share a number of shingles, known
from the sizes, and a shingle among the rarest of each (prefix filter; the length of the prefix uses that an away
member's delta is too large for a link with H).  Members whose deltas share a prefix shingle form the next, smaller
bucket, which gets a hub of its own, and so on until no bucket has many away.  What tells copies of one text apart is
mostly unique, so that the next buckets are few.  Should TURNS not be enough, the pairs left are all made: no two
documents of a bucket stay unlinked without a comparison or a proof, and components are whole.

Nulls and odd cases: null texts and texts without a word have an empty set, n_shingles 0, and are alone; a null id
links with nothing, component_id is null and kept true; rows that share an id are one node but each keeps its row; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import Scratch, by_bytes
from tallyloom.llm.components import components
from tallyloom.llm.hashing import MASK, Words, grams, mix

BATCH_BYTES = 1 << 20
#: Open pairs are made at once in buckets with so many a member or fewer: in those of bands, and in divided ones, where
#: the places of the shared shingle settle most pairs before they are made.
FEW, FEW_DIVIDED = 4, 64
#: How often buckets may be divided before the pairs left are made.
TURNS = 8
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def shingles(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each text of a binary array the sorted distinct hashes of its k-word shingles, or of all its fewer words."""
    words = Words(texts, lower=True)
    h = words.hashes()
    every = grams(h, k)
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        yield np.unique(every[a : b - k + 1]) if b - a >= k else grams(h[a:b], b - a) if b > a else np.empty(0, np.uint64)


def superminhash(elements: np.ndarray, m: int) -> np.ndarray:
    """Signature of a set of 64-bit hashes: m doubles; at least one element."""
    sig = np.full(m, np.inf)
    n = len(elements)
    perm = None
    rows = np.arange(n)
    earlier: list[np.ndarray] = []
    for j in range(m):
        x = mix(elements + np.uint64(int(GOLDEN) * (2 * j + 1) & MASK))
        r = (x >> np.uint64(11)).astype(np.float64) * 2.0**-53
        k = j + (mix(x + GOLDEN) % np.uint64(m - j)).astype(np.int64)
        if j == 0:
            slot = k
        elif j == 1:
            slot = np.where(k == earlier[0], 0, k)
        else:
            if perm is None:
                perm = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.int32), (n, 1))
                for i, e in enumerate(earlier):
                    perm[rows, i], perm[rows, e] = perm[rows, e], perm[rows, i]
            slot = perm[rows, k].astype(np.int64)
            perm[rows, k] = perm[rows, j]
            perm[rows, j] = slot
        if j < 2:
            earlier.append(k)
        np.minimum.at(sig, slot, r + j)
        if sig.max() < j + 1:
            break
    return sig


def _signature_rows(k: int, bands: int, rows: int):
    m = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = (np.arange(bands, dtype=np.uint64) + np.uint64(1)) * GOLDEN
        for batch in by_bytes(batches, "text", BATCH_BYTES):
            sizes, keys, sigs = [], [], []
            for s in shingles(batch.column("text"), k):
                sizes.append(len(s))
                if not len(s):
                    keys.append(None)
                    sigs.append(None)
                    continue
                keys.append(xxhash.xxh128_digest(s.tobytes()))
                bits = superminhash(s, m).view(np.uint64).reshape(bands, rows)
                h = salt.copy()
                for c in range(rows):
                    h = mix(h + bits[:, c])
                sigs.append(h.view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "set_key", "bands"])

    return run


def _set_rows(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", BATCH_BYTES):
            sets = [s.view(np.int64) for s in shingles(batch.column("text"), k)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.list_(pa.int64()))], names=["doc_id", "shingles"])

    return run


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs(u, v) -> (u, v, distance, linked), by intersecting the full sets."""
    a = sets.select(F.col("doc_id").alias("u"), F.col("shingles").alias("a"))
    b = sets.select(F.col("doc_id").alias("v"), F.col("shingles").alias("b"))
    inter = F.size(F.array_intersect("a", "b"))
    both = pairs.join(a, "u").join(b, "v").select("u", "v", inter.alias("i"), (F.size("a") + F.size("b") - inter).alias("n"))
    return both.select("u", "v", (1 - F.col("i") / F.col("n")).alias("distance"), (F.lit(100).cast("long") * F.col("i") >= F.lit(percent).cast("long") * F.col("n")).alias("linked"))


def _possible(percent: int, n: str, c: str, m: str, d: str) -> str:
    """Whether sets of n and m shingles, of which c and d occur elsewhere, can be as near as asked for."""
    return f"100 * least({c}, {d}) >= {percent} * ({n} + {m} - least({c}, {d}))"


def _divided(open_: DataFrame, sets: DataFrame, scratch: Scratch, percent: int, turn: int) -> DataFrame:
    """Buckets of members whose deltas to their hub share a prefix shingle.

    open_(g, rep, n, c, k, away, hub, hub_n) -> (g, rep, n, c, k, away, s, pos, short, many): s shingles in the delta, pos
    of them before the one shared, short: whether it is in the prefix that open pairs of two away members need, many:
    whether the bucket has more open pairs than FEW_DIVIDED a member.
    """
    p, q = percent, 100 - percent
    a = sets.select(F.col("doc_id").alias("rep"), F.col("shingles").alias("a"))
    b = sets.select(F.col("doc_id").alias("hub"), F.col("shingles").alias("b"))
    delta = F.concat(F.array_except("a", "b"), F.array_except("b", "a"))
    rows = open_.join(a, "rep").join(b, "hub").select("g", "rep", "n", "c", "k", "away", "hub_n", delta.alias("delta"))
    rows = scratch.keep(rows.select("g", "rep", "n", "c", "k", "away", "hub_n", F.size("delta").alias("s"), F.explode("delta").alias("x")), f"delta{turn}")
    common = rows.groupBy("g", "x").agg(F.count(F.lit(1)).alias("df"), F.count_if("away").alias("aways")).where("df > 1 and aways > 0").select("g", "x", "df")
    own = [F.max(c).alias(c) for c in ("n", "c", "k", "away", "hub_n", "s")]
    shared = rows.join(common, ["g", "x"]).groupBy("g", "rep").agg(*own, F.sort_array(F.collect_list(F.struct("df", "x"))).alias("xs"))
    # shingles of no other member come first in the order
    shared = shared.withColumn("alone", F.expr("s - size(xs)"))
    shared = shared.withColumn("near", F.expr(f"s - (({100 + p} * s + {q} * (hub_n - n)) div {2 * (100 + p)} + 1) + 1 - alone"))
    shared = shared.withColumn("far", F.expr(f"if(away, greatest(near, s - greatest(1, cast(ceil(({p} * s - {q} * n) / {p}.0) as int)) + 1 - alone), near)"))
    shared = shared.where("far > 0").withColumn("e", F.expr("explode(transform(slice(xs, 1, cast(far as int)), (e, i) -> struct(e.x as x, alone + i as pos, i < near as short)))"))
    out = shared.select(F.xxhash64("g", "e.x").alias("g"), "rep", "n", "c", "k", "away", "s", "e.pos", "e.short")
    out = scratch.keep(out, f"divided{turn}")
    # those open: of a home and an away member, or of two away ones that are short
    mine = [F.count_if(~F.col("away")).cast("double").alias("homes"), F.count_if(F.col("away") & F.col("short")).cast("double").alias("shorts"), F.count_if("away").cast("double").alias("aways")]
    sizes = out.groupBy("g").agg(*mine, F.min("k").alias("lo"), F.max("k").alias("hi")).withColumn("open", F.expr("homes * aways + shorts * (shorts - 1) / 2")).where("open > 0 and lo < hi")
    return out.join(sizes.select("g", "homes", (F.col("open") > FEW_DIVIDED * F.expr("if(homes > 0, homes + aways, shorts)")).alias("many")), "g").where("short or homes > 0")


def near_duplicates(docs: DataFrame, percent: int = 80, k: int = 5, bands: int = 28, rows: int = 4) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs(doc_id, text); see the module's docstring."""
    percent = int(percent)
    if not 0 < percent <= 100:
        raise ValueError("percent must be in (0, 100]")
    scratch = Scratch(docs.sparkSession, "minhash")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    signed = texts.mapInArrow(_signature_rows(k, bands, rows), "doc_id long, n_shingles long, set_key binary, bands array<long>")
    signed = scratch.keep(signed, "signed")
    usable = signed.where("doc_id is not null and set_key is not null")
    classes = scratch.keep(usable.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")), "classes")

    # classes that share a bucket, with n shingles of which c occur in another of them: the others can match nowhere
    slots = classes.select(F.explode("bands").alias("band"), "rep", "n")
    shared = slots.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("band")
    slots = scratch.keep(slots.join(shared, "band"), "slots")
    wanted = slots.select(F.col("rep").alias("doc_id")).distinct()
    sets = scratch.keep(texts.where("doc_id is not null and text is not null").join(wanted, "doc_id").mapInArrow(_set_rows(k), "doc_id long, shingles array<long>"), "sets")
    single = sets.select("doc_id", F.explode("shingles").alias("x")).groupBy("x").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("hi")).where("rep = hi")
    single = single.groupBy("rep").agg(F.count(F.lit(1)).alias("alone"))
    able = slots.join(single, "rep", "left").withColumn("c", F.col("n") - F.coalesce("alone", F.lit(0))).drop("alone").where(f"100 * c >= {percent} * n")

    # the hub of a bucket: the member of which the largest share occurs elsewhere; buckets of the same hub are one
    hubs = able.groupBy("band").agg(F.max(F.struct((F.col("c") / F.col("n")).alias("part"), (-F.col("rep")).alias("less"), F.col("rep"), F.col("n"), F.col("c"))).alias("h"), F.count(F.lit(1)).alias("size")).where("size > 1")
    hubs = hubs.select("band", F.col("h.rep").alias("hub"), F.col("h.n").alias("hub_n"), F.col("h.c").alias("hub_c"))
    members = able.join(hubs, "band").where("rep <> hub").select(F.col("hub").alias("g"), "rep", "n", "c", "hub", "hub_n", "hub_c").distinct()
    members = scratch.keep(members, "members0")
    scratch.drop("slots")

    reach = 1 - percent / 100 + 1e-9
    links, pairs, turn = None, None, 0

    def more(known: DataFrame | None, new: DataFrame) -> DataFrame:
        return new if known is None else known.unionByName(new)

    while True:
        spokes = members.where(_possible(percent, "n", "c", "hub_n", "hub_c")).select(F.col("hub").alias("u"), F.col("rep").alias("v")).distinct()
        met = scratch.keep(_verified(spokes, sets, percent), f"met{turn}")
        links = more(links, met.where("linked").select("u", "v"))
        stars = scratch.keep(components(links, scratch, f"star{turn}_").select(F.col("node").alias("rep"), F.col("component").alias("k")), f"stars{turn}")
        named = members.join(met.select(F.col("u").alias("hub"), F.col("v").alias("rep"), "distance"), ["hub", "rep"], "left").join(stars, "rep", "left").withColumn("k", F.coalesce("k", "rep"))
        named = named.join(stars.select(F.col("rep").alias("hub"), F.col("k").alias("hub_k")), "hub", "left").withColumn("hub_k", F.coalesce("hub_k", "hub")).withColumn("away", F.col("k") != F.col("hub_k"))
        named = scratch.keep(named.select("g", "rep", "n", "c", "hub", "hub_n", "hub_c", "hub_k", "distance", "k", "away"), f"named{turn}")
        sizes = scratch.keep(named.groupBy("g").agg(F.count_if("away").alias("aways"), F.min("k").alias("lo"), F.max("k").alias("hi")).where("aways > 0 and lo < hi").select("g", (F.col("aways") > (FEW if turn < TURNS else 2**62)).alias("many")), f"sizes{turn}")
        kinds = {r["many"] for r in sizes.select("many").distinct().collect()}  # two rows
        if False in kinds:
            few = named.join(sizes.where("not many").select("g"), "g")
            one = few.where("away").select("g", F.col("rep").alias("v"), F.col("n").alias("vn"), F.col("c").alias("vc"), F.col("k").alias("vk"), F.col("distance").alias("vd"))
            two = few.select("g", F.col("rep").alias("u"), F.col("n").alias("un"), F.col("c").alias("uc"), F.col("k").alias("uk"), F.col("away").alias("ua"), F.col("distance").alias("ud"))
            # the Jaccard distance is a metric
            rest = two.join(one, "g").where(f"uk <> vk and (not ua or u < v) and {_possible(percent, 'un', 'uc', 'vn', 'vc')} and (ud is null or vd is null or abs(ud - vd) <= {reach!r})")
            pairs = more(pairs, scratch.keep(rest.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), f"pairs{turn}"))
        if True not in kinds:
            break
        many = named.join(sizes.where("many").select("g"), "g").drop("distance")
        if turn == 0:  # buckets whose hubs are of one component become one, with the hub that most members have
            centre = many.groupBy("hub_k", "hub", "hub_n", "hub_c").agg(F.count(F.lit(1)).alias("m")).groupBy("hub_k").agg(F.max(F.struct("m", (-F.col("hub")).alias("less"), "hub", "hub_n", "hub_c")).alias("h"))
            joined = many.select("hub_k", "rep", "n", "c").distinct().join(centre, "hub_k").where("rep <> h.hub")
            turn = 1
            members = scratch.keep(joined.select(F.col("hub_k").alias("g"), "rep", "n", "c", "h.hub", "h.hub_n", "h.hub_c"), "members1")
            continue
        buckets = _divided(many, sets, scratch, percent, turn)
        buckets = scratch.keep(buckets, f"buckets{turn}")
        # deltas of s and t shingles must share this many, of which those before the shared one are none
        need = f"(us + vs - {100 - percent} * (un + vn) / {100.0 + percent!r}) / 2 - 1e-9"
        small = buckets.where("not many")
        one = small.where("away").select("g", *[F.col(c).alias("v" + c) for c in ("rep", "n", "c", "k", "s", "pos", "short")])
        two = small.select("g", *[F.col(c).alias("u" + c) for c in ("rep", "n", "c", "k", "s", "pos", "short", "away")])
        rest = two.join(one, "g").where(f"uk <> vk and (if(uaway, urep < vrep and vshort, true) and ushort) and {_possible(percent, 'un', 'uc', 'vn', 'vc')} and {need} <= least(us - upos, vs - vpos)")
        pairs = more(pairs, scratch.keep(rest.select(F.least("urep", "vrep").alias("u"), F.greatest("urep", "vrep").alias("v")).distinct(), f"small{turn}"))
        large = buckets.where("many")
        hubs = large.groupBy("g").agg(F.min(F.struct("s", "rep", "n", "c")).alias("h")).select("g", F.col("h.rep").alias("hub"), F.col("h.n").alias("hub_n"), F.col("h.c").alias("hub_c"))
        turn += 1
        members = scratch.keep(large.join(hubs, "g").where("rep <> hub").select("g", "rep", "n", "c", "hub", "hub_n", "hub_c").distinct(), f"members{turn}")
        if members.isEmpty():
            break
    final = stars
    if pairs is not None:
        found = scratch.keep(_verified(pairs.distinct(), sets, percent).where("linked").select("u", "v"), "found")
        if not found.isEmpty():
            final = components(more(links, found), scratch, "whole").select(F.col("node").alias("rep"), F.col("component").alias("k"))
    named = scratch.keep(classes.select("set_key", "rep").join(final, "rep", "left").select("set_key", F.coalesce("k", "rep").alias("component")), "final")
    for name in ("sets", *(f"{n}{t}" for t in range(turn + 1) for n in ("members", "named", "met", "delta", "divided", "buckets", "pairs", "small"))):
        scratch.drop(name)
    out = signed.join(named, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
