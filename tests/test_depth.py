"""Operators against plain Python: greedy clusters, rules by anchors, words and strings near functions, batches, first rows of functions."""

from __future__ import annotations

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from evidentia.operators import detect, inventory, ledger, scan
from evidentia.plans import catalogue

FUNCTIONS = "file_id long, addr long, size int, is_plt boolean, is_simproc boolean, is_blob boolean"


def plain_clusters(functions, edges, roots=300, blob_roots=100):
    """One visited set a file, a queue a root: as the walk is described."""
    out = set()
    for f in {x[0] for x in functions}:
        own = {x[1]: x for x in functions if x[0] == f}
        order = sorted(a for a in own if not own[a][4])
        down, up, visited = {}, {}, set()
        for g, s, d in edges:
            if g == f:
                down.setdefault(s, set()).add(d)
                up.setdefault(d, set()).add(s)
        limit = blob_roots if any(x[5] for x in own.values()) else roots
        for root in sorted(own)[:limit]:
            if own[root][3] or own[root][4] or root in visited:
                continue
            cluster, queue = [root], [(root, 0)]
            visited.add(root)
            while queue:
                a, depth = queue.pop(0)
                if depth >= 3:
                    continue
                ahead = [d for d in down.get(a, ()) if d in own and not own[d][4] and own[d][2] < 1000]
                ahead += [s for s in up.get(a, ()) if s in own and not own[s][4]] if own[a][2] < 500 else []
                if own[a][2] < 200:
                    k = order.index(a)
                    ahead += [n for n in order[max(0, k - 5) : k + 6] if own[n][2] < 300 and abs(n - a) < 2000]
                for n in ahead:
                    if n not in visited:
                        visited.add(n)
                        cluster.append(n)
                        queue.append((n, depth + 1))
            out |= {(f, root, n) for n in cluster if len(cluster) >= 2}
    return out


def graphs():
    r = random.Random(4)
    chain = [(1, 10_000 * k, 400, False, False, False) for k in range(14)]
    yield chain, [(1, 10_000 * k, 10_000 * (k + 1)) for k in range(13)]
    for seed in range(2):
        rows = [(f, a, r.choice([10, 150, 250, 400, 700, 1500]), r.random() < 0.1, r.random() < 0.1, f == 3) for f in (2, 3) for a in sorted(r.sample(range(0, 60_000, 50), 40))]
        by = {f: [x[1] for x in rows if x[0] == f] for f in (2, 3)}
        yield rows, [(f, r.choice(by[f]), r.choice(by[f])) for f in (2, 3) for _ in range(15 + 20 * seed)] + [(2, -1, by[2][0]), (9, 1, 2)]


@pytest.mark.parametrize("held", [0, 10**6])
@pytest.mark.parametrize("number", range(3))
def test_clusters_equal_a_walk_with_one_visited_set(spark, number, held):
    rows, edges = list(graphs())[number]
    got = inventory.function_clusters(spark.createDataFrame(rows, FUNCTIONS), spark.createDataFrame(edges, "file_id long, src long, dst long"), blob_roots=20, held_steps=held)
    assert {tuple(x) for x in got.select("file_id", "root", "func").collect()} == plain_clusters(rows, edges, blob_roots=20)


def test_clusters_of_nothing(spark):
    got = inventory.function_clusters(spark.createDataFrame([], FUNCTIONS), spark.createDataFrame([], "file_id long, src long, dst long"))
    assert got.columns == ["file_id", "root", "func"] and got.count() == 0


def blobs_with_rules() -> list[tuple]:
    from evidentia.plans.findings import _RULE_BYTES

    r = random.Random(6)
    rows = [(i, bytearray(r.randbytes(300) + bytes.fromhex(h) + r.randbytes(50))) for i, h in _RULE_BYTES.items()]
    rows += [(100, None), (101, bytearray()), (102, bytearray(b"\x03")), (103, bytearray(b"\x03\x03")), (104, bytearray(b"HMAC-sha pbkdf2 SCRYPT")), (105, bytearray(bytes(range(256)) * 30))]
    rows += [(200 + i, bytearray(r.choices([0, 1, 2, 3, 0x36, 0x5C, 0xFF, 0x31, 0xC1, 0xC0, 0xE0], k=900))) for i in range(20)]
    return rows


@pytest.mark.parametrize("held", [10**6, 0])
def test_rules_by_anchors_equal_their_regular_expressions(spark, monkeypatch, held):
    monkeypatch.setattr(scan, "HELD_ANCHORS", held)
    blobs = spark.createDataFrame(blobs_with_rules(), "file_id long, data binary")
    got = {tuple(x) for x in scan.rule_scan(blobs, *scan.rule_tables(spark)).collect()}
    assert got == {tuple(x) for x in scan.rule_matches(blobs).collect()}
    fired = {x[1] for x in got}
    assert fired == {x[0] for x in scan.RULES} - {"High_Entropy_Data_Block"}, "every planted rule fires but the one that needs more than five runs in a blob"


def test_anchors_are_sure_bytes(spark):
    for rule in scan.RULES:
        for p in rule[5].values():
            n, value = scan.anchor_of(p)
            fold = bytes.fromhex(__import__("evidentia.plans.findings", fromlist=["_planted"])._planted(p)).lower()
            assert (n == 0) == p.startswith("regex:") and value.to_bytes(n, "little") in fold, p


SECTION, SPAN = "file_id long, vaddr long, data binary", "file_id long, func long, addr long, size int"


@pytest.mark.parametrize("at,near", [(-1001, False), (-1000, True), (-501, True), (-1, True), (64, True), (760, True), (1063, True), (1064, False)])
def test_magic_string_starts_at_most_1000_bytes_off(spark, at, near):
    """A function of 64 bytes at 5000: places from 4000 to 6063 count, wherever the string ends."""
    data = bytearray(b"\0" * (5000 + at - 2000) + detect.MAGIC)
    found = detect.nearby_strings(spark.createDataFrame([(1, 2000, data), (1, 0, None), (2, 2000, data)], SECTION), spark.createDataFrame([(1, 7, 5000, 64)], SPAN))
    assert [tuple(x) for x in found.collect()] == ([(1, 7)] if near else [])


@pytest.mark.parametrize("at,near", [(-504, False), (-500, True), (-498, False), (0, True), (560, True), (564, False)])
def test_words_on_the_grid_of_their_function(spark, at, near):
    data = bytearray(b"\0" * (5000 + at - 2000) + (0x6A09E667).to_bytes(4, "little"))
    found = detect.nearby_words(spark.createDataFrame([(1, 2000, data)], SECTION), spark.createDataFrame([(1, 7, 5000, 64)], SPAN), [0x6A09E667, 0x67452301])
    assert [tuple(x) for x in found.collect()] == ([(1, 7, 0x6A09E667, 5000 + at)] if near else [])


def test_places_of_overlapping_and_repeated_words(spark):
    data = b"aaaa" * 3 + bytes(range(256)) + b"abab"
    wanted = [b"aaa", b"aaaa", b"abab", b"ab", bytes(range(9, 13)), b"aaa", b"nowhere"]
    got = sorted((x.which, x.address) for x in detect.places(spark.createDataFrame([(1, 10, bytearray(data))], SECTION), wanted).collect())
    assert got == sorted((k, 10 + i) for k, w in enumerate(wanted) for i in range(len(data)) if data.startswith(w, i))


def test_a_section_of_four_megabytes_takes_seconds(spark):
    data = bytearray(random.Random(1).randbytes(4_000_000))
    data[3_000_000:3_000_016] = detect.MAGIC
    sections, spans = spark.createDataFrame([(1, 0, data)], SECTION), spark.createDataFrame([(1, 7, 3_000_500, 64), (1, 8, 0, 64)], SPAN)
    began = time.perf_counter()
    assert [tuple(x) for x in detect.nearby_strings(sections, spans).collect()] == [(1, 7)]
    assert detect.nearby_words(sections, spans, [w for ws in detect.HASH_WORDS.values() for w in ws]).count() == 0
    assert time.perf_counter() - began < 60


def test_batches_keep_every_row_with_ties_and_nulls(spark):
    r = random.Random(2)
    rows = [(r.choice(["a", "b", None]), r.choice([1, 2, 2, None]), r.choice([3, 20, None]), i, "x") for i in range(60)]
    got = ledger.token_batches(spark.createDataFrame(rows, "g string, o int, tokens int, n int, batch_number string").repartition(5), 10, "g", "o").collect()
    assert sorted(x.n for x in got) == list(range(60))
    for g in ("a", "b", None):
        own = sorted((x for x in rows if x[0] == g), key=lambda x: (x[1] is not None, x[1] or 0, x[2] or 0))
        number, held, want = 0, 0, []
        for *_, t, _, _ in own:
            t = t or 0
            if number == 0 or t > 10 or held + t > 10:
                number, held = number + 1, t
            else:
                held += t
            want.append((number, t))
        mine = [x for x in got if x.g == g]
        assert sorted((x.batch_number, x.tokens or 0) for x in mine) == sorted(want) and {x.total_batches for x in mine} == {number}
        for x in mine:
            assert (x.items_in_batch, x.estimated_tokens) == (sum(n == x.batch_number for n, _ in want), sum(t for n, t in want if n == x.batch_number))


def test_first_rows_of_a_function_with_very_many(spark):
    ord_ = F.pmod(F.col("id") * 7919, F.lit(300_000))
    insn = spark.range(300_000).select(F.lit(1).alias("file_id"), F.when(F.col("id") % 3 == 0, 1).otherwise(2).alias("func"), ord_.alias("ord"), F.lit("ror").alias("mnemonic"), F.concat(F.lit("r1, "), (ord_ % 50).cast("string")).alias("op_str"))
    got = {x.func: x.rotation_amounts for x in detect.first_rotations(insn).collect()}
    rows = sorted(((i * 7919) % 300_000, 1 if i % 3 == 0 else 2) for i in range(300_000))
    assert got == {f: [o % 50 for o, g in rows if g == f][:10] for f in (1, 2)}
    plan = detect.first_rotations(insn)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("WindowGroupLimit", plan)) >= 2, "rows are cut before and after the exchange"


def test_every_new_query_is_registered():
    assert {"crypto_rules", "nearby_strings", "xor_operations"} <= set(catalogue.QUERIES)
