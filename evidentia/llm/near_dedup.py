"""MinHash near-dedup: a multi-index Hamming join over b-bit signatures, exact confirmation, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from evidentia.llm.graph import connected_components, joined_components
from evidentia.llm.shared import BROADCAST_IDS, by_id, materialize, python_workers, tasks_for
from evidentia.llm.text_hash import STEP, Words, mix, shingle_set

SHINGLE = 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 85
#: A signature has CHUNKS chunks of WIDTH symbols of BITS bits; each symbol is a minimum hash cut to its low bits.
CHUNKS, WIDTH, BITS = 16, 5, 16
#: Symbols of a chunk that may differ: one key is made for each choice of the symbols left out.
ERRORS = 1
#: By pigeonhole, signatures that differ in at most this many symbols share a key: 31 of 80. Two sets at the link threshold differ in 12 on average
#: and in more than 31 with a chance of about 1e-7.
MAX_DISTANCE = CHUNKS * (ERRORS + 1) - 1
#: All pairs of a bucket of up to so many documents may be compared; larger ones are thinned by exact bounds first.
SMALL_BUCKET = 8
#: A shingle is rare if at most so many documents of the large buckets have it.
RARE = 32

#: Pairs whose texts one task compares.
PAIRS_A_TASK = 2_000

_SYMBOLS = CHUNKS * WIDTH
_FACTORS = mix(np.arange(1, _SYMBOLS + 1, dtype=np.uint64) * STEP) | np.uint64(1)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The b-bit minimum hashes of a set that is not empty."""
    least = np.full(_SYMBOLS, np.uint64(0xFFFFFFFFFFFFFFFF))
    for i in range(0, len(shingles), 4096):
        least = np.minimum(least, (_FACTORS[:, None] * shingles[None, i : i + 4096]).min(axis=1))
    return (mix(least) & np.uint64((1 << BITS) - 1)).astype(np.uint16)


def chunk_keys(signatures: np.ndarray) -> np.ndarray:
    """(rows, CHUNKS * WIDTH) keys: each chunk with each one of its symbols left out."""
    parts = signatures.reshape(len(signatures), CHUNKS, WIDTH).astype(np.uint64)
    keys = np.empty((len(signatures), CHUNKS, WIDTH), np.uint64)
    for e in range(WIDTH):
        packed = np.zeros(parts.shape[:2], np.uint64)
        for j in range(WIDTH):
            if j != e:
                packed = (packed << np.uint64(BITS)) | parts[:, :, j]
        place = np.arange(CHUNKS, dtype=np.uint64) * np.uint64(WIDTH) + np.uint64(e + 1)
        keys[:, :, e] = mix(packed ^ mix(place * STEP)[None, :])
    return keys.reshape(len(signatures), -1)


def texts_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, th, t): ids, a hash of the text and the text."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text).cast("binary")).alias("th"), F.col(text).cast("binary").alias("t"))


def sketches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, th, n_shingles, h1, h2, sig): th is a hash of the text, h1 and h2 are hashes of the whole shingle set."""
    python_workers(docs.sparkSession)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in rows:
            n, h1, h2, sig = [], [], [], []
            for t in batch.column(2):
                s = shingle_set(words.hashes(t.as_py()), SHINGLE)
                n.append(len(s))
                h1.append(int(mix(s).sum(dtype=np.uint64).astype(np.int64)))
                h2.append(int(mix(s ^ STEP).sum(dtype=np.uint64).astype(np.int64)))
                sig.append(signature(s).astype("<u2").tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sig, pa.binary())], ["doc_id", "th", "n_shingles", "h1", "h2", "sig"])

    return texts_of(docs, doc_id, text).mapInArrow(run, "doc_id long, th long, n_shingles long, h1 long, h2 long, sig binary")


def bucket_keys(sigs: DataFrame) -> DataFrame:
    """(key, id) of ``sigs`` (id, sig): the allowed chunk errors enumerated."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            if batch.num_rows:
                s = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u2").reshape(-1, _SYMBOLS)
                keys = chunk_keys(s).astype(np.int64)
                ids = np.repeat(np.asarray(batch.column(0)), keys.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(ids)], ["key", "id"])

    return sigs.select("id", "sig").mapInArrow(run, "key long, id long")


def hamming_members(sigs: DataFrame) -> DataFrame:
    """(key, pivot, n, id): the documents of every key that at least two share; pivot is the smallest, n their number.

    Every pair within MAX_DISTANCE shares a key. Keys are counted on the map side first and the rare keys that repeat are written, so that the
    join that brings members back exchanges both sides anew and adaptive skew handling can split a key with very many documents.
    """
    keys = bucket_keys(sigs)
    shared = keys.groupBy("key").agg(F.min("id").alias("pivot"), F.count("*").alias("n")).filter("n > 1")
    return materialize(keys.join(materialize(shared, "shared-keys"), "key").select("key", "pivot", "n", "id"), "members")


def within_distance(pairs: DataFrame, sigs: DataFrame, percent: int, distance: int = MAX_DISTANCE, tasks: int = 0) -> DataFrame:
    """The pairs (a, b) whose set sizes allow a link and whose signatures differ in at most ``distance`` symbols."""
    left = sigs.select(F.col("id").alias("a"), F.col("sig").alias("sa"), F.col("n_shingles").alias("na"))
    right = sigs.select(F.col("id").alias("b"), F.col("sig").alias("sb"), F.col("n_shingles").alias("nb"))
    sized = pairs.join(left, "a").join(right, "b").filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(-1, _SYMBOLS) for i in (2, 3))
                near = pa.array((x != y).sum(axis=1) <= distance)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(near), batch.column(1).filter(near)], ["a", "b"])

    sized = sized.select("a", "b", "sa", "sb")
    return (sized.coalesce(tasks) if tasks else sized).mapInArrow(run, "a long, b long")


def _texts(sets: DataFrame, docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, t), once each, of the sets in ``ids`` (a written table of that one column): sets (id, doc_id, th) name a row of docs (doc_id, th, t)."""
    wanted = materialize(by_id(sets.select("id", "doc_id", "th"), ids), "wanted")
    n = wanted.count()
    texts = materialize(docs.join(F.broadcast(wanted) if n <= BROADCAST_IDS else wanted, ["doc_id", "th"]).select("id", "t"), "texts")
    return texts if texts.count() == n else materialize(texts.dropDuplicates(["id"]), "texts")  # rows may be repeated


def confirm(pairs: DataFrame, sets: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """(a, b, linked) of ``pairs``, from the full shingle sets of both texts."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, last, held = Words(), None, None
        for batch in rows:
            out = []
            for a, x, y in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if held is None or a != last:
                    last, held = a, shingle_set(words.hashes(x.as_py()), SHINGLE)
                other = shingle_set(words.hashes(y.as_py()), SHINGLE)
                both = len(np.intersect1d(held, other, assume_unique=True))
                out.append(100 * both >= percent * (len(held) + len(other) - both) and both > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.bool_())], ["a", "b", "linked"])

    pairs = materialize(pairs, "pairs")
    n = pairs.count()
    if not n:
        return pairs.withColumn("linked", F.lit(False))
    tasks = tasks_for(pairs.sparkSession, n)
    ids = materialize(pairs.coalesce(tasks).select(F.explode(F.array("a", "b")).alias("id")).distinct().coalesce(tasks), "pair-ids")
    texts = _texts(sets, docs, ids)
    joined = pairs.join(texts.select(F.col("id").alias("a"), F.col("t").alias("ta")), "a").join(texts.select(F.col("id").alias("b"), F.col("t").alias("tb")), "b")
    # Texts are compared a few thousand pairs a task.
    joined = joined.select("a", "b", "ta", "tb").coalesce(tasks_for(pairs.sparkSession, n, PAIRS_A_TASK))
    return materialize(joined.mapInArrow(run, "a long, b long, linked boolean"), "confirmed")


def _rare_shingles(ids: DataFrame, sets: DataFrame, docs: DataFrame) -> DataFrame:
    """(s, id, df) of the shingles that at most RARE of the sets ``ids`` have, df being how many have them."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in rows:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = shingle_set(words.hashes(t.as_py()), SHINGLE).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(np.full(len(s), i, np.int64))], ["s", "id"])

    shingles = materialize(_texts(sets, docs, ids).select("id", "t").mapInArrow(run, "s long, id long"), "shingles")
    few = materialize(shingles.groupBy("s").agg(F.count("*").alias("df")).filter(F.col("df") <= RARE), "rare-shingles")
    return materialize(shingles.join(few, "s"), "rare-postings")


def _mixed(members: DataFrame, parts: DataFrame) -> DataFrame:
    """(key, n, id, c) of the buckets of more than two documents that lie in several components c."""
    named = members.join(parts.withColumnRenamed("node", "id"), "id", "left").select("key", "n", "id", F.coalesce("component", "id").alias("c"))
    named = materialize(named, "named")
    tasks = tasks_for(named.sparkSession, named.count())
    keys = named.coalesce(tasks).groupBy("key").agg(F.min("c").alias("c1"), F.max("c").alias("c2")).filter("c1 <> c2").select("key")
    return materialize(named.join(materialize(keys.coalesce(tasks), "mixed-keys"), "key"), "mixed")


def links(sigs: DataFrame, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The components (node, component) that connect whatever is linked among ``sigs`` (id, doc_id, th, n_shingles, sig), docs being (doc_id, th, t).

    1. Each bucket's members are compared with its smallest: one pair a member links most copies.
    2. Large buckets that are still in several components are compared with their cleanest member, the one with most common shingles.
    3. Every pair of a bucket whose ends are still apart is compared, so no link is lost. In large buckets it must pass exact bounds first: two
       documents share a shingle that is rare among the large buckets' documents, or else share common ones only, and then their numbers of
       common shingles bound the intersection. Rare shingles are joined by equality, at most RARE / 2 pairs for each place of one. So a large
       group of loose copies does not give all its pairs.
    """
    members = hamming_members(sigs)
    tasks = tasks_for(members.sparkSession, members.count())
    tried = materialize(members.filter("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).coalesce(tasks).distinct().coalesce(tasks), "star")
    edges = confirm(within_distance(tried, sigs, percent, tasks=tasks), sigs, docs, percent).filter("linked").select("a", "b")
    parts = connected_components(edges)
    wide = members.filter("n > 2")
    rest = _mixed(wide, parts)
    tasks = tasks_for(rest.sparkSession, rest.count())
    ids = materialize(rest.filter(F.col("n") > SMALL_BUCKET).select("id").coalesce(tasks).distinct().coalesce(tasks), "large-ids")
    dense = not ids.isEmpty()
    if dense:
        low = _rare_shingles(ids, sigs, docs)
        lost = low.groupBy("id").agg(F.count("*").alias("low"), F.count_if(F.col("df") == 1).alias("lonely"))
        sized = ids.join(sigs.select("id", "n_shingles"), "id").join(lost, "id", "left").fillna(0, ["low", "lonely"])
        # A shingle that no other document of the large buckets has is in no intersection there.
        able = materialize(sized.filter(100 * (F.col("n_shingles") - F.col("lonely")) >= percent * F.col("n_shingles")).select("id", F.col("n_shingles").alias("size"), (F.col("n_shingles") - F.col("low")).alias("common")).coalesce(tasks), "able")
        thin = rest.filter(F.col("n") > SMALL_BUCKET).join(able, "id")
        cleanest = materialize(thin.groupBy("key").agg(F.max(F.struct("common", (-F.col("id")).alias("neg"), "c")).alias("p")).select("key", (-F.col("p.neg")).alias("p"), F.col("p.c").alias("pc")).coalesce(tasks), "cleanest")
        star = thin.join(cleanest, "key").filter("c <> pc").select(F.least("id", "p").alias("a"), F.greatest("id", "p").alias("b")).coalesce(tasks).distinct().coalesce(tasks)
        star = materialize(star.join(tried, ["a", "b"], "left_anti").coalesce(tasks), "second-star")
        second = confirm(within_distance(star, sigs, percent, tasks=tasks), sigs, docs, percent).filter("linked").select("a", "b")
        tried = tried.unionByName(star)
        parts = joined_components(parts, second)
        rest = _mixed(wide, parts)
    small = rest.filter(F.col("n") <= SMALL_BUCKET).select("key", "id", "c")
    other = small.select("key", F.col("id").alias("b"), F.col("c").alias("cb"))
    pairs = small.join(other, "key").filter("id < b AND c <> cb").select(F.col("id").alias("a"), "b")
    if dense:
        left = rest.filter(F.col("n") > SMALL_BUCKET).join(able, "id").select("key", "id", "c", "size", "common")
        apart = (F.col("id") < F.col("b")) & (F.col("c") != F.col("cb")) & (100 * F.least("size", "size_b") >= percent * F.greatest("size", "size_b"))
        most = F.least("common", "common_b")
        # A pair that shares common shingles only needs enough of them on both sides.
        enough = lambda n, common: 100 * F.col(common) >= percent * F.col(n)
        able = left.filter(enough("size", "common"))
        # A pair meets in each key that both have, and is given out by the smallest of them only; a document has at most CHUNKS * WIDTH keys.
        able = able.join(able.groupBy("id").agg(F.collect_list("key").alias("keys")), "id")
        right = able.select("key", F.col("id").alias("b"), F.col("c").alias("cb"), F.col("size").alias("size_b"), F.col("common").alias("common_b"), F.col("keys").alias("keys_b"))
        bounded = apart & (100 * most >= percent * (F.col("size") + F.col("size_b") - most))
        alike = able.join(right, "key").filter(bounded & (F.array_min(F.array_intersect("keys", "keys_b")) == F.col("key")))
        known = left.select("id", "c", "size", "common").distinct()
        own = low.filter("df > 1").select("s", "id").join(known, "id")
        twin = own.select("s", F.col("id").alias("b"), F.col("c").alias("cb"), F.col("size").alias("size_b"), F.col("common").alias("common_b"))
        sharing = own.join(twin, "s").filter(apart).groupBy("id", "b").agg(F.count("*").alias("shared"), F.first(most).alias("most"), F.first(F.col("size") + F.col("size_b")).alias("sizes"))
        bound = F.col("shared") + F.col("most")
        sharing = sharing.filter(100 * bound >= percent * (F.col("sizes") - bound))
        pairs = pairs.unionByName(alike.select(F.col("id").alias("a"), "b")).unionByName(sharing.select(F.col("id").alias("a"), "b"))
    pairs = pairs.distinct().join(tried, ["a", "b"], "left_anti")
    last = confirm(within_distance(pairs, sigs, percent), sigs, docs, percent).filter("linked").select("a", "b")
    return joined_components(parts, last)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row.

    Words are split at ASCII white space with A-Z lower-cased; a document's set is its distinct 5-word shingles, a shorter text being one. Documents
    are linked if 100 * intersection >= percent * union, confirmed on the full sets; component_id is the smallest doc_id that can be reached
    over links, and kept marks that document. Null, empty or word-less texts have empty sets and stay alone. Rows with equal sets are linked
    through one representative of the set. Rows that repeat a doc_id with other texts are one document that has several sets: whatever is linked with
    one of them is linked with all. A null doc_id stays alone.
    """
    sketch = materialize(sketches(docs, doc_id, text), "sketches")
    same = ["h1", "h2", "n_shingles"]
    known = sketch.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    first = known.groupBy(*same).agg(F.min(F.struct("doc_id", "th", "sig")).alias("r"))
    # Written once, so the numbers of the sets stay as they are.
    sigs = materialize(first.select(F.monotonically_increasing_id().alias("id"), *same, "r.*"), "sets")
    parts = links(sigs, texts_of(docs, doc_id, text), percent)
    repeated = materialize(known.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"), "repeated-ids")
    if not repeated.isEmpty():
        own = materialize(known.join(repeated, "doc_id").join(sigs.select("id", *same), same).select("doc_id", "id").distinct(), "sets-of-ids")
        least = own.groupBy("doc_id").agg(F.min("id").alias("a"))
        parts = joined_components(parts, own.join(least, "doc_id").filter("id <> a").select("a", F.col("id").alias("b")))
    reached = parts.join(sigs.select(F.col("id").alias("node"), "doc_id"), "node")
    smallest = reached.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = sigs.join(reached.select("node", "component").join(smallest, "component"), sigs["id"] == F.col("node"), "left").select(*same, F.coalesce("component_id", sigs["doc_id"]).alias("component_id"))
    out = sketch.filter("doc_id IS NOT NULL").select("doc_id", *same).join(named, same, "left")
    lone = sketch.filter("doc_id IS NULL").select("doc_id", *same, F.lit(None).cast("long").alias("component_id"))
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).unionByName(lone.select("doc_id", "n_shingles", "component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its component, and those with a null doc_id."""
    gone = materialize(near_duplicates(docs, doc_id, text, percent).filter("NOT kept").select(F.col("doc_id").alias("__gone_doc_id")).distinct(), "gone")
    small = gone.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if small else gone, docs[doc_id] == F.col("__gone_doc_id"), "left_anti")
