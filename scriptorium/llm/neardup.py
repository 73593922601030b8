"""Near copies of transcripts by SimHash fingerprints."""

from __future__ import annotations

import uuid
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed, shared_dir


def simhash(text: bytes, words: int = 3, seed: int = 42) -> int:
    """A bit is set if more than half of the shingles' XXH64 values have it.

    ASCII letters are lowered, words are runs without ASCII white space, shingles are
    ``words`` of them joined by spaces, repeats included. A shorter text is one shingle;
    a text without words has fingerprint 0.
    """
    return majority(hashes(text, words, seed))


def hashes(text: bytes, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every shingle of a text, repeats included."""
    parts = text.lower().split()
    if not parts:
        return np.empty(0, "<u8")
    digest = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return np.array([digest(b" ".join(parts), seed)], "<u8")
    return np.array([digest(b" ".join(s), seed) for s in zip(*(parts[i:] for i in range(words)))], "<u8")


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: Column) -> Column:
    """SimHash of a transcript as bigint; null for a null text is the fingerprint of no words, 0."""

    @F.arrow_udf("bigint")
    def of(texts: pa.Array) -> pa.Array:
        found = np.array([simhash(t or b"") for t in texts.cast(pa.binary()).to_pylist()], np.uint64)
        return pa.array(found.view(np.int64))

    return of.asNondeterministic()(text)


def block_keys(code: Column, blocks: int, distance: int) -> Column:
    """Every choice of ``blocks - distance`` blocks of a fingerprint, as (choice, bits).

    Two fingerprints that differ in at most ``distance`` bits differ in at most as many
    blocks, so they share all bits of at least one choice.
    """
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = []
    for chosen in combinations(range(blocks), blocks - distance):
        mask = sum(((1 << edges[b + 1]) - (1 << edges[b])) for b in chosen)
        masks.append(mask - (1 << 64) if mask >= 1 << 63 else mask)
    return F.array(*[F.struct(F.lit(i).alias("choice"), code.bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(masks)])


def close_pairs(codes: DataFrame, *, code: str = "code", distance: int = 2, blocks: int = 4, bucket: int = 32) -> DataFrame:
    """Links (a, b), a < b, that join all distinct fingerprints at most ``distance`` = 2 bits apart.

    Fingerprints meet on blocks and are verified by Hamming distance. A bucket of more than
    ``bucket`` fingerprints is not paired: each of its members goes to itself and its 64
    neighbours at one bit, all that meet there are within two bits of each other, and each
    links to the smallest. Those links are fewer than the pairs and join the same groups.
    """
    if distance != 2:
        raise ValueError("hot buckets are split by neighbours at one bit, which meets pairs at two bits")
    codes = codes.select(F.col(code).alias("code"))
    keyed = codes.select("code", F.explode(block_keys(F.col("code"), blocks, distance)).alias("k")).select("code", "k.choice", "k.bits")
    sizes = keyed.groupBy("choice", "bits").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = checkpointed(keyed.join(sizes, ["choice", "bits"]))  # few: most buckets hold one
    few = met.filter(F.col("n") <= bucket).drop("n")
    a, b = few.withColumnRenamed("code", "a"), few.withColumnRenamed("code", "b")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    pairs = a.join(b, ["choice", "bits"]).filter((F.col("a") < F.col("b")) & near).select("a", "b")

    hot = met.filter(F.col("n") > bucket).select("code").distinct()
    flips = F.array(F.lit(0).cast("bigint"), *[F.lit(1 << i if i < 63 else -(1 << 63)) for i in range(64)])
    spots = hot.select("code", F.explode(F.transform(flips, lambda x: F.col("code").bitwiseXOR(x))).alias("spot"))
    heads = spots.groupBy("spot").agg(F.min("code").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    stars = spots.join(heads, "spot").filter("a < code").select("a", F.col("code").alias("b"))
    return pairs.unionByName(stars).distinct()


def components(links: DataFrame, *, max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node of each connected group, for every node with a link.

    Each round hangs the larger neighbours of a node under the smallest node around it,
    then every node and its smaller neighbours under the smallest of those, until nothing
    changes; a path of n nodes takes about log n rounds. A node's links are combined before
    they are shuffled. Every round is written to the shared folder, over the round before
    the last, so that two rounds are kept at a time.
    """
    spark = links.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/components-{uuid.uuid4().hex}"

    def written(edges, turn):
        edges.write.mode("overwrite").parquet(f"{folder}/{turn % 2}")
        return spark.read.schema(edges.schema).parquet(f"{folder}/{turn % 2}")

    def state(edges):
        return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()

    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), 0)
    now = state(edges)
    for turn in range(1, max_rounds + 1):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        around = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("m"))
        large = edges.join(around, "v").select("u", F.col("m").alias("v")).distinct()
        below = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(below, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(below.select("u", F.col("m").alias("v")))
        edges = written(small.filter("u <> v").distinct(), turn)
        before, now = now, state(edges)
        if before == now:
            return edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    raise RuntimeError(f"groups did not settle in {max_rounds} rounds")


def copy_groups(
    jobs: DataFrame, *, doc_id: str = "doc_id", text: str = "raw_text", distance: int = 2, blocks: int = 4, bucket: int = 32,
) -> tuple[DataFrame, DataFrame]:
    """Each job as (doc_id, code, digest), and each fingerprint as (code, root, first).

    ``root`` is the smallest fingerprint that can be reached, ``first`` the group's first
    row as struct of no_id, doc_id, digest: rows without id come last.
    """
    ids = jobs.select(F.col(doc_id).alias("doc_id"), fingerprint(F.col(text)).alias("code"), F.xxhash64(F.col(text)).alias("digest"))
    ids = checkpointed(ids)
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest")
    codes = checkpointed(ids.groupBy("code").agg(F.min(first).alias("first")))
    roots = components(close_pairs(codes, distance=distance, blocks=blocks, bucket=bucket))
    rooted = codes.join(roots, codes.code == roots.node, "left").select("code", "first", F.coalesce("root", "code").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first").alias("first"))
    return ids, rooted.drop("first").join(named, "root")


def near_duplicates(jobs: DataFrame, **params) -> DataFrame:
    """One row a job: doc_id, fingerprint (16 hexadecimal digits), component_id. Parameters as in ``copy_groups``.

    Transcripts whose fingerprints differ in at most ``distance`` bits are linked, and
    ``component_id`` is the smallest id that can be reached, the row's own included. Null
    texts count as empty; all texts without words have fingerprint 0 and are copies. Rows
    without id are linked like others but name no group, unless none of it has an id. A
    repeated row gives repeated results.
    """
    ids, groups = copy_groups(jobs, **params)
    code = F.lpad(F.lower(F.hex("code")), 16, "0")
    return ids.join(groups, "code").select("doc_id", code.alias("fingerprint"), F.col("first.doc_id").alias("component_id"))


def drop_copies(jobs: DataFrame, *, doc_id: str = "doc_id", text: str = "raw_text", groups=copy_groups, **params) -> DataFrame:
    """Of each group of near copies, as ``groups`` finds them, the row with the smallest id, with all its columns.

    Of rows with the same id and text the one with the smallest other columns stays.
    """
    _, found = groups(jobs, doc_id=doc_id, text=text, **params)
    kept = found.select(*_row_key(F.col("first.doc_id"), F.col("first.digest"))).distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in jobs.columns]).alias("row")
    own = jobs.select(row, *_row_key(F.col(doc_id), F.xxhash64(F.col(text)))).join(kept, ["no_id", "id", "digest"], "left_semi")
    return own.groupBy("no_id", "id", "digest").agg(F.min("row").alias("row")).select("row.*")


@lru_cache(maxsize=4)
def _multipliers(bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(42)
    odd = draw.integers(0, 1 << 63, bands * rows, np.uint64) << np.uint64(1) | np.uint64(1)
    return odd, draw.integers(0, 1 << 63, bands * rows, np.uint64)


def shingles(text: bytes, words: int) -> np.ndarray:
    """XXH64 of the distinct shingles of a text, ascending; words and shingles as in ``simhash``."""
    return np.unique(hashes(text, words))


def band_keys(found: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band of ``rows`` minima of the shingles under random orders.

    Two sets of Jaccard similarity J share a band's key with probability J ** rows.
    """
    odd, plus = _multipliers(bands, rows)
    least = np.full(bands * rows, np.iinfo(np.uint64).max)
    for at in range(0, len(found), 4096):
        mixed = found[at : at + 4096, None] * odd + plus
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        least = np.minimum(least, mixed.min(0))
    return np.array([xxhash.xxh64_intdigest(least[i * rows : (i + 1) * rows].tobytes(), i) for i in range(bands)], np.uint64)


def _sketch(text: Column, words: int, bands: int, rows: int) -> Column:
    """Struct of code, which texts with equal shingles share, print (SimHash), size (shingles) and keys of the bands."""

    @F.arrow_udf("struct<code:bigint,print:bigint,size:int,keys:array<bigint>>")
    def of(texts: pa.Array) -> pa.Array:
        codes, keys, sizes = np.empty(len(texts), np.uint64), np.empty((len(texts), bands), np.uint64), np.empty(len(texts), np.int32)
        prints = np.empty(len(texts), np.uint64)
        for at in range(0, len(texts), 256):
            for i, t in enumerate(texts.slice(at, 256).cast(pa.binary()).to_pylist(), at):
                every = hashes(t or b"", words)
                found = np.unique(every)
                prints[i] = majority(every)
                codes[i], keys[i], sizes[i] = xxhash.xxh64_intdigest(found.tobytes(), 42), band_keys(found, bands, rows), len(found)
        offsets = pa.array(np.arange(0, bands * len(texts) + 1, bands), pa.int32())
        lists = pa.ListArray.from_arrays(offsets, pa.array(keys.view(np.int64).reshape(-1)))
        return pa.StructArray.from_arrays(
            [pa.array(codes.view(np.int64)), pa.array(prints.view(np.int64)), pa.array(sizes), lists], ["code", "print", "size", "keys"]
        )

    return of.asNondeterministic()(text)


def _shingle_set(text: Column, words: int) -> Column:
    @F.arrow_udf("array<bigint>")
    def of(texts: pa.Array) -> pa.Array:
        parts = [pa.array([], pa.list_(pa.int64()))]
        for at in range(0, len(texts), 256):
            found = [shingles(t or b"", words).view(np.int64) for t in texts.slice(at, 256).cast(pa.binary()).to_pylist()]
            parts.append(pa.array(found, pa.list_(pa.int64())))
        return pa.concat_arrays(parts)

    return of.asNondeterministic()(text)


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) whose shingle sets have Jaccard similarity ``least`` or more."""
    one, two = sets.select(F.col("code").alias("a"), F.col("set").alias("x")), sets.select(F.col("code").alias("b"), F.col("set").alias("y"))
    small, large = F.least(F.size("x"), F.size("y")), F.greatest(F.size("x"), F.size("y"))
    met = pairs.join(one, "a").join(two, "b").filter(small >= least * large - 1e-9)
    both = F.size("x") + F.size("y")
    common = F.size(F.array_intersect("x", "y"))
    return met.filter((both == 0) | (common >= least * (both - common) - 1e-9)).select("a", "b")


def _alike(a, b, least: float):
    """Whether two sets of a and b shingles can have Jaccard similarity ``least`` at all."""
    return F.least(a, b) >= least * F.greatest(a, b) - 1e-9


def joining_links(codes: np.ndarray, labels: np.ndarray, sets: list[np.ndarray], firsts: int, least: float) -> list[tuple[int, int]]:
    """Links between the first ``firsts`` sets and all, of similarity ``least`` or more, that join different labels.

    Sets of the same label are joined already. Each link joins two labels into one, so there
    are fewer links than labels; whatever the left-out pairs would link is joined.
    """
    sizes = np.array([len(s) for s in sets])
    flat, ends = np.concatenate(sets) if len(sets) else np.empty(0, np.int64), np.cumsum(sizes)
    number = np.unique(flat, return_inverse=True)[1]
    labels, links = labels.copy(), []
    mark = np.zeros(len(flat) + 1, bool)
    for x in range(firsts):
        other = labels != labels[x]
        if not other.any():
            continue
        own = number[ends[x] - sizes[x] : ends[x]]
        mark[own] = True
        counted = np.concatenate(([0], np.cumsum(mark[number])))
        mark[own] = False
        common = counted[ends] - counted[ends - sizes]
        for y in np.flatnonzero(other & (common >= least * (sizes + sizes[x] - common) - 1e-9)).tolist():
            if labels[y] != labels[x]:
                links.append((int(min(codes[x], codes[y])), int(max(codes[x], codes[y]))))
                labels[labels == labels[y]] = labels[x]
    return links


def _grid(members: DataFrame, sets: DataFrame, least: float, block: int) -> DataFrame:
    """Links (a, b) that join the different roots within each bucket; ``members``: key, code, root, size.

    The members outside a bucket's largest root are compared with all others. Both sides are
    dealt into blocks of about ``block`` members, or of ``block`` x 4,096 shingles if that is
    fewer, and every two blocks meet in a task of their own.
    """
    counts = members.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("size").cast("bigint")).alias("weight"))
    tops = counts.groupBy("key").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("n"), F.sum("weight").alias("weight"))
    blocks = lambda n, weight: F.greatest(F.ceil(n / block), F.ceil(weight / (block * 4096))).cast("int")
    left_n, left_weight = F.col("n") - F.col("top.n"), F.col("weight") * (F.col("n") - F.col("top.n")) / F.col("n")
    tops = tops.select("key", F.col("top.root").alias("top"), blocks(F.col("n"), F.col("weight")).alias("js"), F.greatest(blocks(left_n, left_weight), F.lit(1)).alias("is"))
    deal = lambda count: F.pmod(F.xxhash64("code"), F.col(count)).cast("int")
    cell = lambda i, j, rest: F.struct(i.alias("i"), j.alias("j"), F.lit(rest).alias("rest"))
    numbers = lambda count: F.sequence(F.lit(0), F.col(count) - 1)
    as_any = F.transform(numbers("is"), lambda i: cell(i, deal("js"), False))
    as_rest = F.transform(numbers("js"), lambda j: cell(deal("is"), j, True))
    cells = F.when(F.col("root") == F.col("top"), as_any).otherwise(F.concat(as_any, as_rest))
    dealt = members.join(tops, "key").join(sets, "code").select("key", F.explode(cells).alias("cell"), "code", "root", "set")

    def meet(block: pa.Table) -> pa.Table:
        block = block.sort_by([("rest", "descending")])
        codes, roots = block.column("code").to_numpy(), block.column("root").to_numpy()
        sets = [s.values.to_numpy() for s in block.column("set")]
        links = joining_links(codes, roots, sets, int(block.column("rest").to_numpy().sum()), least)
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return dealt.select("key", "cell.*", "code", "root", "set").groupBy("key", "i", "j").applyInArrow(meet, "a bigint, b bigint")


def similar_groups(
    jobs: DataFrame, *, doc_id: str = "doc_id", text: str = "raw_text", words: int = 5, least: float = 0.8, bands: int = 16, rows: int = 4, bucket: int = 32,
    block: int = 256,
) -> tuple[DataFrame, DataFrame]:
    """As ``copy_groups``, linked by Jaccard similarity of word shingles, ``least`` or more.

    Texts meet in the groups of their SimHash fingerprints (of the same shingles, linked as by
    ``close_pairs``) and where all minima of a band agree, and every link is verified on the
    shingles. Fingerprints alone cannot find such pairs: at 0.8 they differ in about ten bits,
    which no useful blocks survive. Of pairs at 0.8 one in 4,500 shares none of 16 bands of 4.

    In a bucket of more than ``bucket`` texts each is compared to the smallest first. Where
    that joins all, other links would join nothing more. Otherwise the texts that it leaves
    out are compared with all of the bucket, in a grid of blocks of about ``block`` texts,
    and each block returns only links that join something. Fingerprints go first, then one band, three and
    the rest, as what one band has joined the others need not compare. Nothing is capped.

    Null texts count as empty; texts without words are copies of each other. Repeated rows and
    rows equal in id and text are one member of a group; rows without id come last in the
    choice of a group's first. Empty tables give empty results; other columns are not read.
    """
    s = _sketch(F.col(text), words, bands, rows).alias("s")
    ids = jobs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("digest"), s)
    ids = checkpointed(ids.select("doc_id", "digest", "s.*"))
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest")
    codes = checkpointed(ids.groupBy("code").agg(F.min(first).alias("first"), F.first("print").alias("print"), F.first("size").alias("size"), F.first("keys").alias("keys")))
    prints = components(close_pairs(codes.select("print").distinct(), code="print"))
    printed = codes.join(prints, codes["print"] == prints.node, "left").select("code", "size", F.lit(-1).alias("band"), F.coalesce("root", "print").alias("key"))
    keyed = codes.select("code", "size", F.posexplode("keys").alias("band", "key")).unionByName(printed)
    one = F.struct("code", "size")
    heads = keyed.groupBy("band", "key").agg(F.min(one).alias("head"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = checkpointed(keyed.join(heads, ["band", "key"]))  # few: most buckets hold one
    few, many = met.filter(F.col("n") <= bucket), met.filter(F.col("n") > bucket)
    sides = [few.select("band", "key", F.col("code").alias(c), F.col("size").alias(n)) for c, n in (("a", "m"), ("b", "n"))]
    pairs = sides[0].join(sides[1], ["band", "key"]).filter((F.col("a") < F.col("b")) & _alike(F.col("m"), F.col("n"), least)).select("a", "b")
    stars = many.filter((F.col("head.code") < F.col("code")) & _alike(F.col("head.size"), F.col("size"), least))
    pairs = checkpointed(pairs.unionByName(stars.select(F.col("head.code").alias("a"), F.col("code").alias("b"))).distinct())
    wanted = pairs.select(F.col("a").alias("code")).unionByName(pairs.select(F.col("b").alias("code"))).unionByName(many.select("code")).distinct()
    sets = _sets(jobs, codes, wanted, doc_id, text, words)
    links = checkpointed(_verified(pairs, sets, least))
    roots = components(links)
    for part in ((-1, -1), (0, 0), (1, 3), (4, bands)):
        named = many.filter(F.col("band").between(*part)).select(F.xxhash64("band", "key").alias("key"), "code", "size")
        named = named.join(roots, named.code == roots.node, "left").select("key", "code", "size", F.coalesce("root", "code").alias("root"))
        mixed = named.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least < most").select("key")
        open_ = checkpointed(named.join(mixed, "key", "left_semi"))
        if not open_.isEmpty():
            links = checkpointed(links.unionByName(_grid(open_, sets, least, block)).distinct())
            roots = components(links)
    rooted = codes.join(roots, codes.code == roots.node, "left").select("code", "first", F.coalesce("root", "code").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first").alias("first"))
    return ids.drop("keys", "size", "print"), rooted.drop("first").join(named, "root")


def _row_key(id_: Column, digest: Column) -> tuple[Column, ...]:
    return id_.isNull().alias("no_id"), F.coalesce(id_, F.lit(0)).alias("id"), digest.alias("digest")


def _sets(jobs: DataFrame, codes: DataFrame, wanted: DataFrame, doc_id: str, text: str, words: int) -> DataFrame:
    """(code, set): the shingles of the ``wanted`` texts, from the first row of each code."""
    named = codes.join(wanted, "code", "left_semi").select("code", *_row_key(F.col("first.doc_id"), F.col("first.digest")))
    own = jobs.select(F.col(text).alias("text"), *_row_key(F.col(doc_id), F.xxhash64(F.col(text)))).join(named, ["no_id", "id", "digest"])
    return checkpointed(own.select("code", _shingle_set(F.col("text"), words).alias("set")).dropDuplicates(["code"]))
