"""Benchmark decontamination by a positional inverted index over training tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from evidentia.llm.shared import ascii_lower, by_id, materialize

WINDOW = 10
#: Up to so many rows a table of test terms is broadcast (some 100 bytes a row); beyond it joins shuffle.
BROADCAST_ROWS = 300_000
#: Documents' verdicts are broadcast up to so many bytes of them; beyond it they are joined by a shuffle.
BROADCAST_BYTES = 32 << 20
#: Two rare terms of an item's window that stand at most so many words apart in a document are a proximity match.
NEAR = 10
#: Folders of a stored index, by a hash of the term.
INDEX_PARTS = 64


def words_of(text: Column) -> Column:
    """A-Z lower-cased runs of digits, letters and non-ASCII characters; null has none."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", -1), lambda w: w != "")


def _small(df: DataFrame, rows: int = BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """``df`` marked for broadcast if it has at most ``rows`` rows. It must be a written table, so that counting is cheap."""
    return (F.broadcast(df), True) if df.count() <= rows else (df, False)


def postings(docs: DataFrame, terms: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(term, doc_id, pos) of every occurrence of ``terms`` (one column, term) in the texts: the inverted index, limited to test terms."""
    tokens = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(words_of(F.col(text))).alias("pos", "term"))
    return tokens.join(_small(terms)[0], "term").select("term", "doc_id", "pos")


def store_index(docs: DataFrame, path: str, terms: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the positional inverted index of ``docs`` under ``path`` and return it: (term, doc_id, pos, part), in folders by a hash of the term.

    With ``terms`` (one column, term) it holds those terms only. Postings of a very frequent term are spread over files of one folder. The result serves
    any later benchmark as ``contamination``'s ``index``."""
    found = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(words_of(F.col(text))).alias("pos", "term")) if terms is None else postings(docs, terms, doc_id, text)
    placed = found.select("term", "doc_id", "pos", F.pmod(F.xxhash64("term"), F.lit(INDEX_PARTS)).cast("int").alias("part"))
    placed.sortWithinPartitions("part", "term", "doc_id", "pos").write.partitionBy("part").parquet(path)
    return docs.sparkSession.read.schema(placed.schema).parquet(path)


def term_counts(docs: DataFrame, terms: DataFrame, text: str = "text") -> DataFrame:
    """(term, n): occurrences of each of ``terms`` in all texts, counted on the map side first."""
    chosen, small = _small(terms)
    tokens = docs.select(F.explode(words_of(F.col(text))).alias("term"))
    if small:
        return tokens.join(chosen, "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))
    return tokens.groupBy("term").agg(F.count("*").alias("n")).join(chosen, "term", "left_semi")


def item_table(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, item_words) of items that have words; repeated items are kept once."""
    return items.select(F.col(item_id).cast("string").alias("item_id"), words_of(F.col(text)).alias("item_words")).filter(F.size("item_words") > 0).distinct()


def anchors(items: DataFrame, counts: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, t1, o1, t2, o2): for every window the two rarest terms in the corpus and their offsets, without repeats.

    A window with a term that the corpus lacks cannot occur and gives none.
    """
    placed = items.select("item_id", "item_words", F.posexplode("item_words").alias("off", "term")).join(counts, "term", "left")
    ranked = placed.groupBy("item_id", "item_words").agg(F.array_sort(F.collect_list(F.struct("off", F.coalesce("n", F.lit(0)).alias("n"), "term"))).alias("t"))
    length = F.least(F.lit(window), F.size("t"))
    by_rarity = lambda s: F.array_sort(F.transform(F.slice("t", s + 1, length), lambda x: F.struct(x["n"], x["off"], x["term"])))
    wins = ranked.select("item_id", "item_words", F.explode(F.transform(F.sequence(F.lit(0), F.size("t") - length), by_rarity)).alias("w"))
    first, second = F.element_at("w", 1), F.coalesce(F.get("w", F.lit(1)), F.element_at("w", 1))
    return wins.filter(first["n"] > 0).select("item_id", first["term"].alias("t1"), first["off"].alias("o1"), second["term"].alias("t2"), second["off"].alias("o2")).distinct()


def alignments(index: DataFrame, anchor: DataFrame) -> DataFrame:
    """(doc_id, item_id, diag): where an item could lie in a document, diag being the place of its first word.

    Lists are intersected from the rarest term: its postings, moved by its offset, must meet those of the second rarest. A positional join on
    (term, doc_id, pos) keeps a term or passage that very many documents hold spread over all tasks.
    """
    own, _ = _small(anchor)
    start = index.join(own, index["term"] == own["t1"]).select("doc_id", "item_id", (F.col("pos") - F.col("o1")).alias("diag"), F.col("t2").alias("term"), (F.col("pos") - F.col("o1") + F.col("o2")).alias("pos"))
    return start.join(index, ["term", "doc_id", "pos"], "left_semi").select("doc_id", "item_id", "diag").distinct()


def phrase_starts(words: Column, item: Column, diag: Column, window: int = WINDOW) -> Column:
    """Places in ``words`` where a window of ``item`` lies exactly, the item's first word being at ``diag``."""
    length = F.least(F.lit(window), F.size(item))
    last = F.size(item) - length
    same = lambda s: (diag + s >= 0) & (diag + s + length <= F.size(words)) & F.when(diag + s >= 0, F.slice(words, diag + s + 1, length) == F.slice(item, s + 1, length)).otherwise(F.lit(False))
    return F.transform(F.filter(F.sequence(F.lit(0), last), same), lambda s: F.struct((diag + s).alias("s"), (diag + s + length).alias("e")))


def proximity_matches(index: DataFrame, pairs: DataFrame, distance: int) -> DataFrame:
    """(doc_id, t1, pos1, t2, pos2) where terms of ``pairs`` (t1, t2; written) stand at most ``distance`` words apart, in either order.

    Positions are dealt to buckets of ``distance`` words, so the join is by equality on document and bucket.
    """
    left = index.withColumnRenamed("pos", "pos1").join(_small(pairs)[0], F.col("term") == F.col("t1")).drop("term").withColumn("bucket", F.explode(F.array(*(F.floor(F.col("pos1") / distance) + d for d in (-1, 0, 1)))))
    right = index.select(F.col("term").alias("t2"), "doc_id", F.col("pos").alias("pos2"), F.floor(F.col("pos") / distance).alias("bucket"))
    near = left.join(right, ["doc_id", "t2", "bucket"]).filter((F.abs(F.col("pos1") - F.col("pos2")) <= distance) & ((F.col("t1") != F.col("t2")) | (F.col("pos1") != F.col("pos2"))))
    return near.select("doc_id", "t1", "pos1", "t2", "pos2").distinct()


def _covered(spans: Column) -> Column:
    """Words in the union of spans (s, e)."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("last"))
    step = lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], a["last"]))).alias("n"), F.greatest(a["last"], x["e"]).alias("last"))
    return F.aggregate(F.array_sort(spans), start, step, lambda a: a["n"])


def _checked(places: DataFrame, texts: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """(_doc, _text, _items, _spans): items and spans of the windows that really lie at ``places`` in texts (doc_id, th, words)."""
    tried = places.groupBy("doc_id", "item_id").agg(F.collect_list("diag").alias("diags"))  # at most one place a word of the document
    rows = tried.join(texts, "doc_id").join(_small(items)[0], "item_id")
    spans = F.array_distinct(F.flatten(F.transform("diags", lambda d: phrase_starts(F.col("words"), F.col("item_words"), d, window))))
    found = rows.select("doc_id", "th", "item_id", spans.alias("spans")).filter(F.size("spans") > 0)
    both = found.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("item_id")).alias("_items"), F.array_distinct(F.flatten(F.collect_list("spans"))).alias("_spans"))
    return both.select(F.col("doc_id").alias("_doc"), F.col("th").alias("_text"), "_items", "_spans")


def contamination(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, near: int | None = None, index: DataFrame | None = None
) -> DataFrame:
    """``docs`` plus n_words, n_hit, n_items, items_sha256, contaminated and hit_spans ([s, e) in words); with ``near``, n_near too.

    A window is ``window`` consecutive item words; a shorter item, but not an empty one, is one window. Null or empty texts have no words and
    no hits. Repeated document ids are judged together (their candidate places are shared, each row is then checked exactly against its own
    text); repeated items count once by id. A null document id finds nothing. Columns of ``docs`` with these names are replaced.
    n_near: items that have a window whose two rarest terms stand at most ``near`` words apart in the document, in either order. ``index``: a stored index
    of these documents, which is then read instead of their texts, but for the exact check.
    """
    new = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hit_spans", "n_near")
    own_items = materialize(item_table(items, item_id, item_text), "items")
    terms = materialize(own_items.select(F.explode("item_words").alias("term")).distinct(), "terms")
    counted = term_counts(docs, terms, text) if index is None else index.groupBy("term").agg(F.count("*").alias("n")).join(_small(terms)[0], "term", "left_semi")
    anchor = materialize(anchors(own_items, materialize(counted, "term-counts"), window), "anchors")
    used = materialize(anchor.select(F.explode(F.array("t1", "t2")).alias("term")).distinct(), "anchor-terms")
    lists = materialize(postings(docs, used, doc_id, text) if index is None else index.join(_small(used)[0], "term").select("term", "doc_id", "pos"), "postings")
    places = materialize(alignments(lists, anchor), "alignments")
    # The row travels as one struct, so none of its columns can clash with those used here.
    rows = docs.select(F.struct("*").alias("_row")).withColumn("_th", F.xxhash64(F.col("_row")[text]))
    texts = rows.select(F.col("_row")[doc_id].alias("doc_id"), F.col("_th").alias("th"), F.col("_row")[text].alias("t"))
    wanted = by_id(texts, materialize(places.select("doc_id").distinct(), "candidates"), "doc_id").distinct()
    found = materialize(_checked(places, wanted.select("doc_id", "th", words_of(F.col("t")).alias("words")), own_items, window), "verdicts")
    heavy = found.agg(F.sum(F.size("_spans") * 8 + F.length(F.array_join("_items", ",")) + 24)).first()[0] or 0
    done = rows.join(F.broadcast(found) if heavy <= BROADCAST_BYTES else found, (F.col("_row")[doc_id] == F.col("_doc")) & (F.col("_th") == F.col("_text")), "left")
    if near:
        pairs = materialize(anchor.select("item_id", "t1", "t2").distinct(), "term-pairs")
        close = proximity_matches(lists, materialize(pairs.select("t1", "t2").distinct(), "pairs"), near).select("doc_id", "t1", "t2").distinct()
        n_near = close.join(_small(pairs)[0], ["t1", "t2"]).select("doc_id", "item_id").distinct().groupBy(F.col("doc_id").alias("_near_doc")).agg(F.count("*").alias("_near"))
        n_near = materialize(n_near, "near")
        done = done.join(F.broadcast(n_near) if n_near.count() * 16 <= BROADCAST_BYTES else n_near, F.col("_row")[doc_id] == F.col("_near_doc"), "left")
    spans, hit_items = F.coalesce("_spans", F.array().cast("array<struct<s:int,e:int>>")), F.coalesce("_items", F.array().cast("array<string>"))
    n_hit = _covered(spans).cast("long")
    rest = [F.col("_row")[c].alias(c) for c in docs.columns if c not in new]
    return done.select(
        *rest,
        F.size(words_of(F.col("_row")[text])).cast("long").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size(hit_items).cast("long").alias("n_items"),
        F.sha2(F.array_join(hit_items, ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        spans.alias("hit_spans"),
        *([F.coalesce("_near", F.lit(0)).cast("long").alias("n_near")] if near else []),
    )


ORACLE = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, array_to_string(list_slice(ws, i, i + least(10, len(ws)) - 1), ' ') AS g, least(10, len(ws)) AS n FROM (SELECT item_id, ws, unnest(generate_series(1, len(ws) - least(10, len(ws)) + 1)) AS i FROM b WHERE len(ws) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS g FROM (SELECT doc_id, ws, n, unnest(generate_series(1, len(ws) - n + 1)) AS i FROM w, ns WHERE len(ws) >= n)),
h AS (SELECT doc_id, item_id, i, n FROM dw JOIN bw USING (g, n)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS x FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM h) GROUP BY doc_id),
k AS (SELECT term, count(*) AS n FROM (SELECT unnest(ws) AS term FROM w) GROUP BY term),
it AS (SELECT DISTINCT item_id::VARCHAR AS item_id, ws FROM b WHERE len(ws) > 0),
o AS (SELECT item_id, ws, s, off, ws[off + 1] AS term FROM (SELECT item_id, ws, s, unnest(generate_series(s, s + least(10, len(ws)) - 1)) AS off FROM (SELECT item_id, ws, unnest(generate_series(0, len(ws) - least(10, len(ws)))) AS s FROM it))),
r AS (SELECT item_id, ws, s, o.term, coalesce(k.n, 0) AS n, row_number() OVER (PARTITION BY item_id, ws, s ORDER BY coalesce(k.n, 0), off, o.term) AS rank FROM o LEFT JOIN k ON o.term = k.term),
a AS (SELECT DISTINCT x.item_id, x.term AS t1, coalesce(y.term, x.term) AS t2 FROM (SELECT * FROM r WHERE rank = 1 AND n > 0) x LEFT JOIN (SELECT * FROM r WHERE rank = 2) y ON x.item_id = y.item_id AND x.ws = y.ws AND x.s = y.s),
q AS (SELECT doc_id, unnest(ws) AS term, generate_subscripts(ws, 1) AS pos FROM w),
near AS (SELECT p1.doc_id, count(DISTINCT item_id) AS n FROM a JOIN q p1 ON p1.term = t1 JOIN q p2 ON p2.term = t2 AND p2.doc_id = p1.doc_id
  WHERE abs(p1.pos - p2.pos) <= 10 AND (t1 <> t2 OR p1.pos <> p2.pos) GROUP BY p1.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(x, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
       coalesce(near.n, 0)::BIGINT AS n_near
FROM w LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN near USING (doc_id)
"""
