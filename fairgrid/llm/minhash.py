"""MinHash near-dedup with b-bit signatures.

1. Each document's set of 5-word shingles is hashed to 64 bits; 128 minima give 32 band keys of 4 minima, and the
   two low bits of each minimum are packed into four longs.
2. Documents with equal sets are one class, so exact copies cost one row from here on.
3. Classes that share a band key are candidates. First each class meets only the likeliest of its buckets'
   smallest and largest members, then, twice, the likeliest member of another component in a block of its bucket;
   the collision-corrected similarity of the packed bits rules out far pairs and full sets confirm the others.
   Confirmed links are joined to components, so groups of near copies collapse without their pairs being listed.
4. Buckets that still hold several components are then searched for every pair across components, each pair in
   the first band that it shares: bits pick the rows that have such a pair, and tasks over tiles of two blocks of
   a bucket compare full sets and give only the links. No candidate pair that could join two components goes
   unseen, and no pairs are listed.

Two sets with similarity 0.75 share no band with probability (1 - 0.75**4)**32 = 5e-6. Pairs are dropped on bits
below an estimate of 0.55, more than four standard deviations under 0.75.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairgrid.llm.common import HOT_ROWS, documents, join_hot, materialise, release_table, worker_table

WORDS, HASHES, BANDS, BITS = 5, 128, 32, 2
#: Links have 100 * intersection >= LINK * union.
LINK = 75
#: Least estimated similarity that full sets are compared at.
FLOOR = 0.55
#: Members of a pivot that meet it in one task; members of a bucket that meet each other in the rounds of step 3.
MEMBERS, BLOCK = 256, 512
#: Shingles of a block's members together, some 8 MB a tile; a longer set has a block of its own.
BLOCK_SHINGLES = 1 << 19
#: Rounds of step 3 after the first.
ROUNDS = 2
#: Ids that full sets are fetched for by broadcast; more are fetched by a shuffle of the texts.
BROADCAST_ROWS = 300_000
_random = np.random.default_rng(20240229)
MULTIPLY = (_random.integers(1, 1 << 32, HASHES, np.uint64) | np.uint64(1)).astype(np.uint32)
ADD = _random.integers(0, 1 << 32, HASHES, np.uint64).astype(np.uint32)
PLACES = _random.integers(1, 1 << 63, 8, np.uint64) | np.uint64(1)
SIGNATURE = ["s0", "s1", "s2", "s3"]


class _WordHashes(dict):
    """64-bit hashes of words, each computed once until the table is full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word)
        return out


def _finalised(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: all bits of the result depend on all bits of ``x``."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the text's 5-word shingles; of the whole sequence with fewer words; none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(worker_table(("word-hashes",), _WordHashes).__getitem__, words), np.uint64, len(words))
    n = min(WORDS, len(words))
    total = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        total += hashes[k : len(words) - n + 1 + k] * PLACES[k]
    return np.unique(_finalised(total))


def minima(hashed: np.ndarray) -> np.ndarray:
    """Least value of each hash function over the set, in blocks of bounded size."""
    short = (hashed >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(short), 4096):
        np.minimum(out, (MULTIPLY[:, None] * short[None, at : at + 4096] + ADD[:, None]).min(axis=1), out=out)
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band, different for equal minima of different bands."""
    rows = least.reshape(BANDS, HASHES // BANDS).astype(np.uint64)
    return _finalised((rows * PLACES[: HASHES // BANDS]).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * PLACES[7]).view(np.int64)


def packed_bits(least: np.ndarray) -> np.ndarray:
    """The low BITS of each minimum, a plane of 128 bits each, as four longs."""
    bits = least ^ (least >> np.uint32(16))
    bits = bits * np.uint32(0x85EBCA6B)
    bits ^= bits >> np.uint32(13)
    return np.concatenate([np.packbits((bits >> np.uint32(k)).astype(np.uint8) & 1) for k in range(BITS)]).view(np.int64)


def estimate(a: str, b: str) -> Column:
    """Similarity of two packed signatures, corrected for low bits that agree by chance."""
    differ = [F.bit_count(F.col(f"{a}{k}").bitwiseXOR(F.col(f"{b}{k}")).bitwiseOR(F.col(f"{a}{k + 2}").bitwiseXOR(F.col(f"{b}{k + 2}")))) for k in (0, 1)]
    agree = 1 - (differ[0] + differ[1]) / F.lit(float(HASHES))
    return (agree - 2.0**-BITS) / (1 - 2.0**-BITS)


def signatures(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, set_digest, bands, s0..s3`` of whole texts."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, keys, bits = [], [], [], []
            for value in batch.column(1):
                hashed = shingles(value.as_py())
                sizes.append(len(hashed))
                digests.append(xxhash.xxh3_128_digest(hashed.tobytes()))
                least = minima(hashed)
                keys.append(band_keys(least) if len(hashed) else np.zeros(0, np.int64))
                bits.append(packed_bits(least))
            planes = np.array(bits, np.int64).reshape(-1, 4)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, keys)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *keys])))
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), lists, *(pa.array(planes[:, k]) for k in range(4))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "set_digest", "bands", *SIGNATURE])
        release_table()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(sign, f"doc_id {kind}, n_shingles long, set_digest binary, bands array<long>, s0 long, s1 long, s2 long, s3 long")


def _with_sets(rows: DataFrame) -> DataFrame:
    """Replace ``text`` by ``hashes``, its full set."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            sets = [shingles(x.as_py()).view(np.int64) for x in batch.column(at)]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *sets])))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(batch.num_columns) if k != at), lists], names=[*(n for n in batch.schema.names if n != "text"), "hashes"])
        release_table()

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.mapInArrow(add, f"{kept}, hashes array<long>")


def confirmed(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full sets link, counted on the sets.

    ``b``'s set goes to each of the tasks that its partners are dealt to, MEMBERS of them in each.
    """
    dealt = pairs.groupBy("b").agg((F.floor(F.count(F.lit(1)) / MEMBERS) + 1).cast("int").alias("_tasks"))
    left = join_hot(pairs, dealt, "b").select(F.col("a").alias("doc_id"), "b", F.pmod(F.xxhash64("a"), F.col("_tasks")).cast("int").alias("_task"), F.lit(False).alias("_pivot"))
    right = dealt.select(F.col("b").alias("doc_id"), "b", F.explode(F.sequence(F.lit(0), F.col("_tasks") - 1)).alias("_task"), F.lit(True).alias("_pivot"))
    needed = materialise(left.unionByName(right), "minhash-needed")
    sets = _with_sets(_texts_of(docs, needed))
    path = materialise(sets, "minhash-sets")
    members = path.where("not _pivot").select(F.col("doc_id").alias("a"), "b", "_task", F.col("hashes").alias("_ours"))
    pivots = path.where("_pivot").select("b", "_task", F.col("hashes").alias("_theirs"))
    both = members.join(pivots, ["b", "_task"])
    common = F.size(F.array_intersect("_ours", "_theirs"))
    links = both.where(100 * common >= LINK * (F.size("_ours") + F.size("_theirs") - common))
    return materialise(links.select("a", "b").distinct(), "minhash-links")


def _slices(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """Frames of rows sorted by ``keys`` cut into whole groups: (rows, starts, ends)."""
    held: pd.DataFrame | None = None
    for frame in frames:
        held = frame if held is None else pd.concat([held, frame], ignore_index=True)
        values = held[keys].to_numpy(np.int64)
        fresh = np.ones(len(held), bool)
        fresh[1:] = (values[1:] != values[:-1]).any(axis=1)
        ends = np.flatnonzero(fresh)
        if len(ends) > 1:
            yield held, ends[:-1], ends[1:]
            held = held.iloc[ends[-1] :].reset_index(drop=True)
    if held is not None and len(held):
        yield held, np.array([0]), np.array([len(held)])


def _likeness(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Estimated similarity of each row of ``one`` with each of ``other``, a few rows at a time."""
    one, other = (np.ascontiguousarray(x).view(np.uint64) for x in (one, other))  # numpy counts the bits of a negative number's absolute value
    out = np.empty((len(one), len(other)), np.float32)
    for at in range(0, len(one), 64):
        own = one[at : at + 64, None]
        differ = sum(np.bitwise_count((own[..., k] ^ other[None, :, k]) | (own[..., k + 2] ^ other[None, :, k + 2])) for k in (0, 1))  # 128 at most
        out[at : at + 64] = (1 - differ / HASHES - 2.0**-BITS) / (1 - 2.0**-BITS)
    return out


def _sizes_link(sizes: np.ndarray) -> np.ndarray:
    """Whether sets of two sizes can link at all: the smaller has LINK hundredths of the larger's members at least."""
    return 100 * np.minimum(sizes[:, None], sizes[None, :]) >= LINK * np.maximum(sizes[:, None], sizes[None, :])


def _nominate(members: DataFrame) -> DataFrame:
    """``a, b``: for each class its likeliest partner of another component, over the blocks of its buckets.

    ``members`` has ``key, block, rep, component, n_shingles, s0..s3``; rows of a block stream through one task together.
    """

    def pick(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, starts, ends in _slices(frames, ["key", "block"]):
            reps, parts, bits, sizes = rows["rep"].to_numpy(), rows["component"].to_numpy(), rows[SIGNATURE].to_numpy(np.int64), rows["n_shingles"].to_numpy(np.int64)
            out_a, out_b, out_sim = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
            for start, end in zip(starts, ends, strict=True):
                own = slice(start, end)
                sim = _likeness(bits[own], bits[own])
                sim[(parts[own, None] == parts[None, own]) | ~_sizes_link(sizes[own])] = -1
                best = sim.argmax(axis=1)
                sims = sim[np.arange(len(best)), best]
                good = sims >= FLOOR
                out_a.append(reps[own][good])
                out_b.append(reps[own][best[good]])
                out_sim.append(sims[good])
            yield pd.DataFrame({"a": np.concatenate(out_a), "b": np.concatenate(out_b), "sim": np.concatenate(out_sim)})

    rows = members.select("key", "block", "rep", "component", "n_shingles", *SIGNATURE).repartition("key", "block").sortWithinPartitions("key", "block", "rep")
    found = rows.mapInPandas(pick, "a long, b long, sim double")
    return found.groupBy("a").agg(F.max_by("b", F.struct("sim", -F.col("b"))).alias("b"))


TILE = ["key", "tile_i", "tile_j"]


def _tile_pairs(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of a tile that full sets must be compared for, likeliest first.

    Pairs across components whose estimate reaches FLOOR and whose first shared band is this bucket's; in a tile
    of two blocks, pairs across the blocks.
    """
    parts, bits, blocks = rows["component"].to_numpy(), rows[SIGNATURE].to_numpy(np.int64), rows["block"].to_numpy()
    sim = _likeness(bits, bits)
    open_pairs = (sim >= FLOOR) & (parts[:, None] < parts[None, :]) & _sizes_link(rows["n_shingles"].to_numpy(np.int64))
    if rows["tile_i"].iloc[0] != rows["tile_j"].iloc[0]:
        open_pairs &= blocks[:, None] != blocks[None, :]
    a, b = np.nonzero(open_pairs)
    if len(a):
        bands = np.array(rows["bands"].tolist(), np.int64)
        first = np.concatenate([np.argmax(bands[a[k : k + 65536]] == bands[b[k : k + 65536]], axis=1) for k in range(0, len(a), 65536)])
        mine = bands[a, first] == rows["key"].iloc[0]
        a, b = a[mine], b[mine]
    order = np.argsort(-sim[a, b], kind="stable")
    return a[order], b[order]


def _links_across(docs: DataFrame, members: DataFrame) -> DataFrame:
    """``a, b``: links between components of a bucket, enough to join all components that any link joins."""
    blocks = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    tiles = members.withColumn("_y", F.explode(blocks)).withColumn("tile_i", F.least("block", "_y")).withColumn("tile_j", F.greatest("block", "_y")).drop("_y", "blocks")
    kept = [*TILE, "block", "rep", "component", "n_shingles", "bands", *SIGNATURE]
    kinds = "key long, tile_i long, tile_j long, block long, doc_id long, component long, n_shingles long, bands array<long>, s0 long, s1 long, s2 long, s3 long"

    def pick(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, starts, ends in _slices(frames, TILE):
            out = []
            for start, end in zip(starts, ends, strict=True):
                own = rows.iloc[start:end].reset_index(drop=True)
                a, b = _tile_pairs(own)
                out.append(own.iloc[np.unique(np.concatenate([a, b]))])
            yield pd.concat(out).rename(columns={"rep": "doc_id"})

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, starts, ends in _slices(frames, TILE):
            found = []
            for start, end in zip(starts, ends, strict=True):
                own = rows.iloc[start:end].reset_index(drop=True)
                ids, parts, sets = own["doc_id"].to_numpy(), own["component"].to_numpy(), own["hashes"].tolist()
                joined = {x: x for x in parts.tolist()}

                def root(x: int, joined: dict[int, int] = joined) -> int:
                    while joined[x] != x:
                        joined[x] = joined[joined[x]]
                        x = joined[x]
                    return x

                for a, b in zip(*_tile_pairs(own), strict=True):
                    p, q = root(parts[a]), root(parts[b])
                    if p != q:
                        common = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                        if 100 * common >= LINK * (len(sets[a]) + len(sets[b]) - common):
                            joined[max(p, q)] = min(p, q)
                            found.append((ids[a], ids[b]))
            yield pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)

    needed = tiles.select(*kept).repartition(*TILE).sortWithinPartitions(*TILE, "rep").mapInPandas(pick, kinds)
    needed = materialise(needed, "minhash-needed")
    sets = _with_sets(_texts_of(docs, needed)).repartition(*TILE).sortWithinPartitions(*TILE, "doc_id")
    return materialise(sets.mapInPandas(compare, "a long, b long"), "minhash-links")


def _texts_of(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """``needed`` with the text of its ``doc_id``.

    Texts of the ids are picked out by broadcast where the ids are few, and else by a shuffle of all texts; then
    both meet by id.
    """
    texts = docs.select("doc_id", "text")
    ids = materialise(needed.select("doc_id").distinct(), "minhash-ids")
    few = ids.count() <= BROADCAST_ROWS
    own = texts.join(F.broadcast(ids), "doc_id", "left_semi") if few else texts.hint("merge").join(ids, "doc_id", "left_semi")
    return needed.hint("merge").join(own, "doc_id")


def _mixed(met: DataFrame, found: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows of buckets that hold more than one component: ``key, rep, component, n_shingles, block, blocks, bands, s0..s3``; blocks are bounded in rows and in shingles."""
    labelled = met.select("key", "rep", "n_shingles").join(found.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", "n_shingles", F.coalesce("component", "rep").alias("component"))
    labelled = materialise(labelled, "minhash-labelled")
    several = labelled.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("_n"), F.sum("n_shingles").alias("_s")).where("lo < hi").select("key", "_n", "_s")
    blocks = F.floor(F.greatest(F.col("_n") / BLOCK, F.col("_s") / BLOCK_SHINGLES)) + 1
    rows = labelled.join(several, "key").select("key", "rep", "component", "n_shingles", F.pmod(F.xxhash64("rep"), blocks).alias("block"), blocks.alias("blocks"))
    return materialise(rows.join(classes.select("rep", "bands", *SIGNATURE), "rep"), "minhash-mixed")


def components(links: DataFrame) -> DataFrame:
    """``node, component``: the smallest node reachable over ``links`` (a, b), by least labels and pointer jumps."""
    ends = links.select(F.col("a").alias("node"), F.col("b").alias("to")).union(links.select("b", "a")).distinct()
    ends = materialise(ends, "component-ends")
    labels = materialise(ends.groupBy("node").agg(F.least(F.col("node"), F.min("to")).alias("component")), "component-labels")
    rows = ends.count()
    while True:
        near = join_hot(ends, labels.withColumnRenamed("node", "to"), "to", rows=rows).groupBy("node").agg(F.min("component").alias("_near"))
        least = labels.join(near, "node").select("node", F.col("component").alias("_was"), F.least("component", "_near").alias("component"))
        target = labels.select(F.col("node").alias("component"), F.col("component").alias("_next"))
        least = materialise(least, "component-least") if rows >= HOT_ROWS else least
        jumped = join_hot(least, target, "component", "left", rows).select("node", "_was", F.least(F.col("component"), F.col("_next")).alias("component"))
        step = materialise(jumped, "component-labels")
        labels = step.select("node", "component")
        if step.where("component <> _was").isEmpty():
            return labels


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``, a row for each row of ``docs``.

    Texts without words have an empty set and are linked with nothing, and neither are rows with a null doc_id
    (component null, kept). Rows sharing a doc_id are one document: a link of one of its texts is a link of all.
    A null doc_id is kept; very long texts are read whole; other types of id than integers are an error. Only
    ``doc_id`` and ``text`` are read; an empty table gives an empty result.
    """
    if not isinstance(docs.schema["doc_id"].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        raise TypeError("doc_id must be an integer")
    signed = materialise(signatures(docs), "minhash-signatures")
    usable = signed.where("n_shingles > 0 and doc_id is not null")
    alike = [F.first(c).alias(c) for c in ("n_shingles", "bands", *SIGNATURE)]  # equal sets have equal signatures
    classes = materialise(usable.groupBy("set_digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("_rows"), *alike), "minhash-classes")

    keys = classes.select("rep", "n_shingles", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi")
    met = materialise(keys.join(shared, "key"), "minhash-buckets")
    bits = classes.select("rep", *SIGNATURE)
    ours = bits.select(F.col("rep").alias("a"), *(F.col(s).alias(f"a{s[1]}") for s in SIGNATURE))
    theirs = bits.select(F.col("rep").alias("b"), *(F.col(s).alias(f"b{s[1]}") for s in SIGNATURE))
    pivots = materialise(met.select(F.col("rep").alias("a"), F.explode(F.array("lo", "hi")).alias("b")).where("a <> b").distinct(), "minhash-pivots")
    scored = join_hot(pivots, theirs, "b").join(ours, "a").select("a", "b", estimate("a", "b").alias("_sim")).where(F.col("_sim") >= FLOOR)
    first_pairs = materialise(scored.groupBy("a").agg(F.max_by("b", F.struct("_sim", -F.col("b"))).alias("b")), "minhash-pairs")
    links = confirmed(docs, first_pairs)
    found = components(links)

    seen = first_pairs.select("a", "b")
    for _ in range(ROUNDS):
        nominated = _nominate(_mixed(met, found, classes))
        nominated = materialise(nominated.join(seen.union(seen.select("b", "a")), ["a", "b"], "left_anti"), "minhash-pairs")
        links = links.unionByName(confirmed(docs, nominated))
        found = components(links)
        seen = seen.unionByName(nominated.select("a", "b"))

    more = _links_across(docs, _mixed(met, found, classes))
    if not more.isEmpty():
        found = components(links.unionByName(more).distinct())

    total = signed.count()
    named = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("set_digest", "_rows", F.coalesce("component", "rep").alias("component_id"))
    named = materialise(named, "minhash-components")
    rows = signed.select("doc_id", "n_shingles", "set_digest")
    hot = named.where(F.col("_rows") * 1000 >= total).select("set_digest", F.col("component_id").alias("_hot"))  # 1000 rows at most
    marked = rows.join(F.broadcast(hot), "set_digest", "left")
    busy = marked.where("_hot is not null").select("doc_id", "n_shingles", F.col("_hot").alias("component_id"))
    rest = marked.where("_hot is null").drop("_hot").join(named.where(F.col("_rows") * 1000 < total), "set_digest", "left").select("doc_id", "n_shingles", "component_id")
    both = busy.unionByName(rest)
    own = F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return both.select("doc_id", "n_shingles", own.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query: all ``documents``, five words, similarity 0.75."""
    return near_duplicates(documents(spark, sf_dir))


OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
met AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT x, y FROM met JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * common >= 75 * (p.n + q.n - common)),
edges AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT x, y FROM edges UNION SELECT r.x, e.y FROM reach r JOIN edges e ON r.y = e.x),
least_id AS (SELECT x AS doc_id, min(y) AS low FROM reach GROUP BY x)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(low, w.doc_id)) AS component_id, w.doc_id = least(w.doc_id, coalesce(low, w.doc_id)) AS kept
FROM w LEFT JOIN n ON w.doc_id = n.doc_id LEFT JOIN least_id l ON w.doc_id = l.doc_id
"""
