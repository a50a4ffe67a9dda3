"""Hand-made facts with values that follow from the rules."""

from __future__ import annotations

import json
import math

import pytest
from pyspark.sql import functions as F

from evidentia.functions import adapter, classify, jsonfix, registry, text as tx
from evidentia.operators import detect, infer, inventory, ledger, report, scan
from evidentia.sources import binary, sinks
from evidentia.streaming import calls as streaming

SECTION = "file_id long, name string, vaddr long, data binary"


def insn(spark, *ops, func=1):
    rows = [(1, func, i % 3, i, m, o, i * 4) for i, (m, o) in enumerate(ops)]
    return spark.createDataFrame(rows, "file_id long, func long, block long, ord int, mnemonic string, op_str string, offset long")


def one(df):
    rows = df.collect()
    assert len(rows) == 1, rows
    return rows[0]


def test_signatures_count_offsets_in_bytes(spark):
    blob = b"\xc3\xa9\xe2\x82\xac1234" + bytes.fromhex("637c777bf26b") + bytes.fromhex("6a09e667f3bcc908")
    sections = spark.createDataFrame([(1, ".data", 0x1000, bytearray(blob)), (1, ".bad", 0, None)], SECTION)
    got = {r.name: r.offset for r in scan.signature_scan(sections, scan.signature_table(spark)).collect()}
    assert got["AES_SBOX_FIRST_BYTES"] == "0x1009"
    assert {n for n, o in got.items() if o == "0x100f"} == {"SHA256_INIT_H0", "SHA512_INIT_H0", "BLAKE2B_IV0", "BLAKE2S_IV0"}
    groups = {r.algorithm: (r.n, r.confidence_level) for r in scan.constant_groups(scan.signature_scan(sections, scan.signature_table(spark))).collect()}
    assert groups["BLAKE2"] == (2, "high") and groups["AES"] == (1, "high")


@pytest.mark.parametrize(
    "data,rule,fires",
    [
        (bytes.fromhex("67e6096a"), "SHA256_Constants", False),
        (bytes.fromhex("67e6096a85ae67bb"), "SHA256_Constants", True),
        (b"\x36" * 8, "HMAC_Implementation", False),
        (b"\x36" * 8 + b"\x5c" * 8, "HMAC_Implementation", True),
        (bytes.fromhex("310a85407409"), "Cryptographic_XOR_Loops", True),
        (b"use pbkdf2 here", "PBKDF2_KDF", True),
        (b"$argon2id$v=19", "Bcrypt_Scrypt_Argon2", True),
        (b"\x00" + b"x" * 127 + b"\x00", "RSA_ECC_Primes", True),
        (b"\x00" + b"x" * 126 + b"\x00", "RSA_ECC_Primes", False),
    ],
)
def test_rules(spark, data, rule, fires):
    found = scan.rule_matches(spark.createDataFrame([(1, bytearray(data))], "file_id long, data binary"))
    assert (rule in {r.rule for r in found.collect()}) == fires


def test_rule_confidence(spark):
    rows = [(1, "a", "AES", "high", 1), (2, "a", "A", "high", 30), (2, "b", "B", "medium", 1), (2, "c", "C", "low", 1)]
    got = {r.file_id: r.confidence for r in scan.rule_summary(spark.createDataFrame(rows, "file_id long, rule string, algorithm string, severity string, match_count long")).collect()}
    assert got == {1: 0.18, 2: 0.45}


def test_strings_at_the_end_of_a_section(spark):
    s = spark.createDataFrame([(1, ".data", 0, bytearray(b"\x00AES key\x00rsa-pub"))], SECTION)
    assert [r.string for r in scan.interesting_strings(s).orderBy("ord").collect()] == ["AES key", "rsa-pub"]
    assert [r.string for r in scan.interesting_strings(s, closed=True).collect()] == ["AES key"]


def test_keys(spark):
    good = bytes.fromhex("8091a2b3c4d5e6f7")
    rows = [(1, ".data", 64, good + b"\x01"), (2, ".data", 0, b"\x00" * 33), (3, ".data", 0, b"\xff" * 33), (4, ".rodata", 0, bytes.fromhex("67452301") + bytes(range(128, 141))), (5, ".text", 0, good + b"\x01"), (6, ".data", 0, good)]
    found = scan.key_windows(spark.createDataFrame([(i, n, v, bytearray(d)) for i, n, v, d in rows], SECTION))
    r = one(found.filter("file_id IN (1, 2, 3, 5, 6)"))
    assert (r.file_id, r.offset, r.size, r.key_type) == (1, 64, 8, "DES key or IV")
    assert not found.filter("file_id = 4 AND offset = 0").collect()
    assert scan.first_keys(found).filter("ord > 10").count() == 0


def test_entropy_and_little_endian(spark):
    r = spark.range(1).select(tx.entropy_of(F.array(*(F.lit(i) for i in range(8)))).alias("e"), tx.entropy_of(F.array().cast("array<int>")).alias("z"), tx.little_endian(F.unhex(F.lit("78563412"))).alias("le"), tx.hex_address(F.lit(4106)).alias("h")).first()
    assert math.isclose(r.e, 3.0) and r.z == 0.0 and r.le == 0x12345678 and r.h == "0x100a"


def test_rotations_weigh_shifts_by_half(spark):
    r = one(detect.bit_rotations(detect.function_counts(insn(spark, ("ror", "r1, 7"), ("lsl", "r1, 2"), ("lsl", "r1, 3")))))
    assert (r.rotation_count, r.crypto_indicator, r.rotation_amounts) == (2, "moderate", [7]) and r.likely_algorithm.startswith("ChaCha20")


def test_arx_threshold(spark):
    r = one(detect.arx_operations(detect.function_counts(insn(spark, ("add", ""), ("add", ""), ("eor", ""), ("eor", None), ("lsr", "")))))
    assert math.isclose(r.arx_score, 5 / 3)
    assert not detect.arx_operations(detect.function_counts(insn(spark, ("add", ""), ("eor", ""), ("eor", ""), ("lsr", "")))).collect()


def test_modular_and_tables(spark):
    counts = detect.function_counts(insn(spark, *[("mul", "x0, x1")] * 3, ("udiv", "x0"), ("movzx", "eax, [rbx]"), ("ldrb", "w0, [x1]")))
    assert one(detect.modular_arithmetic(counts)).wide_operations == 6 and one(detect.table_lookups(counts)).table_accesses == 2


@pytest.mark.parametrize("memory,total,kind", [(15, 100, "Hybrid"), (25, 100, "Hybrid"), (26, 100, "S-box"), (14, 100, "ARX")])
def test_memory_ratio_edges(spark, memory, total, kind):
    r = one(detect.memory_ratios(insn(spark, *[("ldr", "[r1]")] * memory, *[("add", "")] * (total - memory))))
    assert r.classification.startswith(kind)


def test_feistel_and_rounds(spark):
    r = one(detect.feistel_networks(insn(spark, ("mov", "r1, r2"), ("mov", "r3, r4"), ("eor", ""), ("eor", ""), ("orr", "r1, wzr, r2"))))
    assert (r.register_copies, r.confidence) == (2, 0.8)
    loops = spark.createDataFrame([(1, 1, 0, b) for b in range(2)] + [(1, 1, 1, b) for b in range(14)] + [(1, 1, 2, b) for b in range(20)], "file_id long, func long, loop_id int, block long")
    r = one(detect.round_loops(loops))
    assert (r.loop_blocks, r.potential_rounds) == (14, 12) and one(detect.hottest_loops(loops)).loop_id == 2


def test_hash_words_in_operands_and_near_by(spark):
    ops = insn(spark, ("mov", "r0, 0x6a09e667"), ("mov", "r1, 0x67452301"))
    r = one(detect.hash_constants(ops))
    assert (r.constant_count, r.algorithm, r.confidence) == (2, "SHA-1", "medium")
    words = [w for ws in detect.HASH_WORDS.values() for w in ws]
    sections = spark.createDataFrame([(1, 1000, bytearray(b"\0" * 4 + (0xD76AA478).to_bytes(4, "little") + b"\0" * 8))], "file_id long, vaddr long, data binary")
    functions = spark.createDataFrame([(1, 1, 1200, 64), (1, 2, 9000, 64)], "file_id long, func long, addr long, size int")
    near = detect.nearby_words(sections, functions, words)
    assert [(x.func, x.address) for x in near.collect()] == [(1, 1004)]
    assert one(detect.hash_constants(insn(spark, ("mov", "r0, 0xe8c7b756")), near)).algorithm == "MD5"
    assert detect.magic_constants(insn(spark, ("mov", "r0, 0x61707865"), ("mov", "r1, 0x3320646e"))).count() == 1


def test_likelihood_is_capped_and_between_0_and_1(spark):
    rows = spark.createDataFrame([(3, 3, 3), (0, 0, 0), (1, 1, 0), (99, 99, 99)], "x int, r int, m int")
    got = [r.s for r in rows.select(infer.likelihood(F.col("x"), F.col("r"), F.col("m")).alias("s")).collect()]
    assert got[0] == 1.0 and got[1] == 0.0 and math.isclose(got[2], 0.27) and got[3] == 1.0


def test_suppression_is_idempotent(spark):
    rows = spark.createDataFrame([(1, "a", 0.95, "symmetric", 1), (1, "b", 0.85, "symmetric", 2), (1, "c", 0.7, "symmetric", 3), (1, "d", 0.6, "hash", 4), (1, "e", 0.2, "unknown", 5)], "file_id long, algorithm string, confidence double, category string, func long")
    once = infer.dominate(rows)
    assert {r.algorithm for r in once.collect()} == {"a", "b", "d", "e"} == {r.algorithm for r in infer.dominate(once).collect()}


def test_inference_of_an_arx_file(spark):
    ops = insn(spark, *[("add", "")] * 60, *[("eor", "")] * 60, *[("ror", "r1, 7")] * 30)
    counts = detect.function_counts(ops)
    loops = spark.createDataFrame([(1, 1, 0, b) for b in range(3)], "file_id long, func long, loop_id int, block long")
    found = {"feistel": detect.feistel_networks(ops), "arx": detect.arx_operations(counts), "tables": detect.table_lookups(counts), "loops": detect.round_loops(loops), "modular": detect.modular_arithmetic(counts), "hashes": detect.hash_constants(ops), "ratios": detect.memory_ratios(ops), "magic": detect.magic_constants(ops)}
    got = {(r.algorithm, r.confidence) for r in infer.inferred(found).collect()}
    assert got == {("ChaCha20/Salsa20/BLAKE2", 0.85), ("Unknown cipher (3 rounds)", 0.7)}


def test_binary_wide_row_when_all_else_is_suppressed(spark):
    ops = insn(spark, ("ldr", "[r1]"), ("ldr", "[r1]"), *[("add", "")] * 20).unionByName(insn(spark, ("ldr", "[r1]"), ("ldr", "[r1]"), *[("add", "")] * 20, func=2))
    counts = detect.function_counts(ops)
    loops = spark.createDataFrame([], "file_id long, func long, loop_id int, block long")
    found = {"feistel": detect.feistel_networks(ops), "arx": detect.arx_operations(counts), "tables": detect.table_lookups(counts), "loops": detect.round_loops(loops), "modular": detect.modular_arithmetic(counts), "hashes": detect.hash_constants(ops), "ratios": detect.memory_ratios(ops), "magic": detect.magic_constants(ops)}
    assert one(infer.inferred(found)).algorithm.startswith("AES (inlined")


FUNC = "file_id long, addr long, name string, size int, num_blocks int, edges int, nodes int, is_plt boolean, is_simproc boolean, is_blob boolean"


def test_function_extraction(spark):
    rows = [(1, 10, "a", 9, 4, 9, 4, False, False, False), (1, 20, "b", 9, 4, 4, 4, False, False, False), (1, 30, "plt", 9, 4, 90, 4, True, False, False), (1, 40, "c", 9, 5, None, None, False, False, False), (1, 50, "d", 9, 0, 20, 2, False, False, None), (2, 10, "e", 9, 4, 9, 4, False, False, True)]
    tags = spark.createDataFrame([(1, 20, "AES")], "file_id long, addr long, tag string")
    got = [(r.name, r.complexity, r.has_hit) for r in inventory.extract_functions(spark.createDataFrame(rows, FUNC), tags).orderBy("file_id", "ord").collect()]
    assert got == [("d", 20, False), ("a", 7, False), ("c", 5, False), ("b", 2, True)]
    assert [r.name for r in inventory.extract_functions(spark.createDataFrame(rows, FUNC), None, limit=1).collect()] == ["a"]
    assert [r.name for r in inventory.extract_functions(spark.createDataFrame(rows, FUNC), None, limit=1, topk=True).collect()] == ["d"]


def test_clusters_and_their_fallback(spark):
    fn = spark.createDataFrame([(1, a, "f", s, 1, 1, 1, False, False, False) for a, s in ((100, 900), (5000, 50), (5100, 60), (90000, 400), (500000, 5000))], FUNC)
    edges = spark.createDataFrame([(1, 100, 5000), (1, 90000, 500000)], "file_id long, src long, dst long")
    groups = inventory.function_clusters(fn, edges)
    assert {(r.root, r.func) for r in groups.collect()} == {(100, 100), (100, 5000), (100, 5100)}
    none = spark.createDataFrame([], "file_id long, addr long")
    assert [r.addr for r in inventory.functions_from_groups(none, groups).orderBy("addr").collect()] == [100, 5000, 5100]


CALLS = [
    ("gpt-4o-mini", "openai", 1000, 500, 2.5, True, None),
    ("gpt-4o", "openai", 5000, 2000, 15.3, True, None),
    ("claude-3-5-sonnet-20241022", "anthropic", 8000, 3000, 20.1, True, None),
    ("gpt-4o", "openai", 3000, 1500, 12.0, False, "Rate limit exceeded"),
]
PRICES = [("gpt-4o", "openai", 0.0025, 0.010), ("gpt-4o-mini", "openai", 0.00015, 0.0006), ("claude-3-5-sonnet-20241022", "anthropic", 0.003, 0.015)]


def test_cost_report(spark, tmp_path):
    calls = spark.createDataFrame(CALLS, "model string, provider string, input_tokens long, output_tokens long, duration_seconds double, success boolean, error_message string")
    prices = spark.createDataFrame(PRICES, "model string, provider string, price_in double, price_out double")
    done = ledger.priced(calls, prices)
    rows = ledger.cost_report(done)
    got = json.loads(rows.first().report)
    assert (got["total_calls"], got["successful_calls"], got["failed_calls"], got["success_rate"]) == (4, 3, 1, 0.75)
    assert math.isclose(got["total_cost"], 0.12445) and math.isclose(got["average_duration"], 12.475) and math.isclose(got["total_duration"], 49.9) and math.isclose(got["avg_cost_per_call"], 0.0311125)
    assert (got["input_tokens"], got["output_tokens"], got["total_tokens"]) == (17000, 7000, 24000)
    assert math.isclose(got["by_provider"]["openai"], 0.05545) and math.isclose(got["by_model"]["gpt-4o"], 0.055)
    levels = {(r.level, r.model, r.provider): r.n_calls for r in ledger.cost_levels(done).collect()}
    assert levels["total", None, None] == 4 and levels["model", "gpt-4o", None] == 2
    assert ledger.call_statistics(done.limit(0)).first().success_rate == 0.0
    sinks.write_cost_report(rows, f"file://{tmp_path}/r", "text")
    assert "Total cost: $0.124450" in spark.read.text(f"file://{tmp_path}/r", wholetext=True).first()[0]
    with pytest.raises(ValueError):
        sinks.write_cost_report(rows, "x", "xml")
    unknown = ledger.priced(calls.limit(1).withColumn("model", F.lit("nope")), prices).first()
    assert (unknown.cost, unknown.provider) == (0.0, "unknown")


def test_cache(spark, tmp_path):
    entries = spark.createDataFrame([("aa", "old", 1.0, 10), ("aa", "new", 5.0, 10), ("bb", "x", 1.0, 3), ("cc", "y", 4.0, 100)], "key string, value string, ts double, ttl int")
    sinks.append_cache(entries, f"file://{tmp_path}/cache")
    cache = spark.read.parquet(f"file://{tmp_path}/cache").drop("shard")
    asked = spark.createDataFrame([("aa",), ("bb",), ("zz",)], "key string")
    assert [(r.key, r.value) for r in ledger.cache_hits(asked, cache, F.lit(10.0)).collect()] == [("aa", "new")]
    assert sorted(r.key for r in ledger.cache_misses(asked, cache, F.lit(10.0)).collect()) == ["bb", "zz"]
    assert sorted(r.key for r in ledger.cleaned(cache, F.lit(10.0)).collect()) == ["aa", "cc"]
    assert sorted(r.key for r in ledger.evicted(ledger.latest(cache)).collect()) == ["aa", "cc"]
    assert sorted(r.key for r in ledger.deleted(cache, asked).collect()) == ["cc"]
    assert ledger.cache_stats(ledger.latest(cache)).first().bytes == 5
    keys = spark.createDataFrame([({"b": "1", "a": "2"},), ({"a": "2", "b": "1"},)], "c map<string,string>")
    assert keys.select(ledger.cache_key(F.lit("v"), F.lit("q"), F.col("c"), F.lit("k"))).distinct().count() == 1


@pytest.mark.parametrize("sizes,want", [([3, 3, 3, 3], [1, 1, 1, 2]), ([20, 1, 1], [1, 2, 2]), ([5, 20, 5, 5], [1, 2, 3, 3]), ([10, 1], [1, 2]), ([20, 20], [1, 2])])
def test_batches_partition_their_input(spark, sizes, want):
    items = spark.createDataFrame([(1, i, s) for i, s in enumerate(sizes)], "g int, o int, tokens int")
    got = ledger.token_batches(items, 10, "g", "o").orderBy("o").collect()
    assert [r.batch_number for r in got] == want and {r.total_batches for r in got} == {max(want)}
    assert sum(r.tokens for r in got) == sum(sizes)


@pytest.mark.parametrize(
    "raw,want",
    [
        ('{"a": 1} and more', {"a": 1}),
        ('Sure: {"a": [1, 2]}', {"a": [1, 2]}),
        ('```json\n[{"a": 1}, {"b": "cut', [{"a": 1}, {"b": "cut"}]),
        ('```\n{"x": {"patterns": [', {"x": {"patterns": []}}),
        ('{"a": [1, 2,], }', {"a": [1, 2]}),
        ('{"a": "line\nbreak"}', {"a": "line\nbreak"}),
        ('{"a": 1, "b":', {"a": 1}),
        ('{"a": "esc\\', {"a": "esc"}),
        ("nothing", None),
        ("", None),
        (None, None),
    ],
)
def test_json_repair(raw, want):
    got = jsonfix.repaired(raw)
    assert (json.loads(got) if got else None) == want


def test_json_quarantine(spark, tmp_path):
    df = spark.createDataFrame([(1, '{"a":1}'), (2, '{"a":[1'), (3, "bad"), (4, None)], "id int, t string")
    got = {r.id: (r.how, r.json) for r in jsonfix.checked(df, "t").collect()}
    assert got == {1: ("parsed", '{"a":1}'), 2: ("repaired", '{"a":[1]}'), 3: ("fallback", "{}"), 4: ("fallback", "{}")}
    sinks.quarantine(jsonfix.checked(df, "t"), f"file://{tmp_path}/q")
    assert spark.read.parquet(f"file://{tmp_path}/q").first().t == "bad"


def test_scores_and_report(spark, tmp_path):
    v = spark.createDataFrame([(1, "weak", "critical", "DES", "e"), (1, "weak", "high", "MD5", "e"), (1, "weak", "medium", "x", "e"), (1, "weak", "low", "y", "e")], "file_id long, type string, severity string, algorithm string, evidence string")
    a = spark.createDataFrame([(1, "AES-256-GCM", 0.9, "e"), (1, "SHA-256", 0.4, "e"), (2, "AES-256", 0.6, "e")], "file_id long, algorithm string, confidence double, evidence string")
    scores = report.security_score(v, a)
    assert {r.file_id: r.security_score for r in scores.collect()} == {1: 30, 2: 100}
    meta = spark.createDataFrame([(1, "f.bin"), (3, "g.bin")], "file_id long, filename string")
    f = spark.createDataFrame([(1, "enc", 0.7), (1, "no", 0.5)], "file_id long, name string, confidence double")
    p = report.protocols_by_algorithms(spark.createDataFrame([(1, "AES-GCM"), (1, "ECDHE"), (2, "DH")], "file_id long, algorithm string"))
    got = {r.file_id: r.report for r in report.report(meta, a, f, p, v, scores).collect()}
    assert [x.algorithm for x in got[1].detected_algorithms] == ["AES-256-GCM"] and [x.name for x in got[1].detected_functions] == ["enc"]
    assert [x.severity for x in got[1].vulnerabilities] == ["critical", "high", "medium", "low"] and got[3].vulnerabilities == [] and got[3].explainability.security_score == 100
    assert got[1].detected_protocols[0].implementation_status == "partial"
    sinks.write_reports(report.report(meta, a, f, p, v, scores), f"file://{tmp_path}/out")
    assert spark.read.json(f"file://{tmp_path}/out").count() == 2
    linked = report.linked(a, f.withColumn("related_algorithm", F.lit("aes-256-gcm")), v).filter("algorithm = 'AES-256-GCM'").first()
    assert linked.functions == ["enc", "no"]


def test_small_classifiers(spark):
    r = spark.range(1).select(report.severity_of(F.lit("DES")).alias("des"), report.severity_of(F.lit("DES/3DES")).alias("tdes"), report.severity_of(F.lit("RSA"), F.lit(1024)).alias("rsa"), report.library_of(F.lit("EVP_EncryptInit")).alias("lib"), report.triage(F.lit("AES key")).alias("t1"), report.triage(F.lit("plain")).alias("t2"), classify.confidence_band(F.lit(0.2)).alias("b"), classify.rounds(F.lit(11)).alias("n"), ledger.should_batch(F.lit(40001), F.lit(1)).alias("s")).first()
    assert (r.des, r.tdes, r.rsa, r.lib, r.t1, r.t2, r.b, r.n, r.s) == ("critical", None, "critical", "OpenSSL", "deep", "skip", None, 10, True)


def elf() -> bytes:
    names = b"\0.data\0.shstrtab\0"
    body = b"\x63\x7c\x77\x7b\xf2\x6b\x00\x00"
    head = lambda n, k, a, o, s: n.to_bytes(4, "little") + k.to_bytes(4, "little") + (0).to_bytes(8, "little") + a.to_bytes(8, "little") + o.to_bytes(8, "little") + s.to_bytes(8, "little") + bytes(24)
    table = 64 + len(body) + len(names)
    start = b"\x7fELF\x02\x01\x01" + bytes(9) + (2).to_bytes(2, "little") + (62).to_bytes(2, "little") + (1).to_bytes(4, "little") + (0x401000).to_bytes(8, "little") + bytes(8) + table.to_bytes(8, "little") + bytes(4) + (64).to_bytes(2, "little") + bytes(4) + (64).to_bytes(2, "little") + (3).to_bytes(2, "little") + (2).to_bytes(2, "little")
    return start + body + names + head(0, 0, 0, 0, 0) + head(1, 1, 0x5000, 64, len(body)) + head(7, 3, 0, 64 + len(body), len(names))


def test_files_sections_and_tools(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(elf())
    (tmp_path / "b.bin").write_bytes(b"raw blob with an AES key inside\x00")
    (tmp_path / "empty.bin").write_bytes(b"")
    files = binary.read_files(spark, f"file://{tmp_path}", "*.bin")
    assert inventory.file_metadata(files).count() == 2
    heads = {r.filename: r.h for r in files.select("filename", binary.header(F.col("content")).alias("h")).collect()}
    assert (heads["a.bin"].os, heads["a.bin"].arch, heads["a.bin"].bits, heads["a.bin"].entry) == ("unix", "x86_64", 64, 0x401000) and heads["b.bin"].os == "unknown"
    sections = binary.sections(files)
    found = registry.tool("constants")(spark, {"section": sections})
    assert [(r.name, r.address) for r in found.collect()] == [("AES_SBOX_FIRST_BYTES", 0x5000)]
    assert registry.tool("strings")(spark, {"section": sections}).first().string.startswith("raw blob")
    with pytest.raises(KeyError):
        registry.tool("nope")


def test_settings_and_prompts(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"models": {"main": {"provider": "p", "model": "m", "cost_per_1k_input_tokens": 0.5, "max_tokens": 9}}}')
    (tmp_path / "p.txt").write_text("  ")
    r = binary.read_settings(spark, f"file://{tmp_path}/m.json").first()
    assert (r.key, r.setting.model, r.setting.max_tokens) == ("main", "m", 9)
    assert binary.read_prompt(spark, f"file://{tmp_path}/p.txt", "default").first().text == "default"


def test_range_tags_and_offsets(spark):
    spans = spark.createDataFrame([(1, 0, 100), (2, 90, 500), (3, 5, 5)], "span int, lo long, hi long")
    points = spark.createDataFrame([(95, "a"), (100, "b"), (499, "c"), (500, "d")], "at long, tag string")
    assert {(r.span, r.tag) for r in inventory.range_tags(points, spans, 16).collect()} == {(1, "a"), (2, "a"), (2, "b"), (2, "c")}
    sections = spark.createDataFrame([(1, 64, 16, 0x5000)], "file_id long, file_offset long, size long, vaddr long")
    moved = inventory.address_of_offset(spark.createDataFrame([(1, 70, "x"), (1, 90, "y")], "file_id long, at long, tag string"), sections)
    assert one(moved).at == 0x5006


def test_adapter_retries(spark):
    def client(model, prompt):
        if prompt == "bad":
            raise ValueError("no")
        return prompt.upper(), 1, 2

    asked = spark.createDataFrame([("k1", "m", "hi"), ("k2", "m", "bad")], "key string, model string, prompt string")
    got = {r.key: r for r in adapter.complete(asked, client, retries=1, pause=0.0).collect()}
    assert (got["k1"].content, got["k1"].success) == ("HI", True) and got["k2"].attempts == 2 and "ValueError" in got["k2"].error_message


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.bin").write_bytes(b"abc")
    spark.conf.set("spark.sql.streaming.schemaInference", "true")
    q = streaming.arriving_files(spark, f"file://{tmp_path}/in").select("length").writeStream.format("memory").queryName("files").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT length FROM files").first().length == 3
    rows = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id) AS ts, CASE WHEN id % 2 = 0 THEN 'a' ELSE 'b' END AS model, 1.5D AS cost, CAST(id % 3 AS STRING) AS key FROM (SELECT CAST(id AS INT) AS id FROM range(20))")
    rows.write.parquet(f"file://{tmp_path}/calls")
    source = spark.readStream.schema(rows.schema).parquet(f"file://{tmp_path}/calls")
    q = streaming.running_totals(source).writeStream.outputMode("complete").format("memory").queryName("totals").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.model, r.n_calls, r.total_cost) for r in spark.sql("SELECT * FROM totals").collect()} == {("a", 10, 15.0), ("b", 10, 15.0)}
    q = streaming.first_requests(source).writeStream.format("memory").queryName("firsts").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT key FROM firsts").count() == 3


def test_whole_analysis_skips_forces_and_names_missing_facts(spark):
    from evidentia.operators import job

    files = spark.createDataFrame([(1,), (2,), (3,), (1,)], "file_id long")
    strings = spark.createDataFrame([(1, "nothing here"), (1, "AES key"), (2, "plain words"), (9, "cipher"), (1, None)], "file_id long, string string")
    insn = spark.createDataFrame([(1, 10, b, b, "xor", "r0, r1", 0) for b in range(3)] + [(1, 20, 0, 9, "add", "r0, r1", 0)], "file_id long, func long, block long, ord long, mnemonic string, op_str string, offset long")
    loops = spark.createDataFrame([], "file_id long, func long, loop_id long, block long")
    functions = spark.createDataFrame([(1, 10, "f", 9, 4, 9, 3, False, False, False)], "file_id long, addr long, name string, size int, num_blocks int, edges int, nodes int, is_plt boolean, is_simproc boolean, is_blob boolean")
    got = {r.file_id: r for r in job.analysed(files, strings, insn, loops, insn, functions).collect()}
    assert sorted(got) == [1, 2, 3]
    assert (got[1].route, got[1].skipped, got[1].errors, got[1].n_functions, got[1].security_score, got[1].stages_completed) == ("deep", False, "", 1, 100, 7)
    assert [(r.route, r.skipped, r.errors, r.security_score, r.stages_completed) for r in (got[2], got[3])] == [("skip", True, "", None, 1)] * 2
    forced = {r.file_id: r for r in job.analysed(files, strings, insn, loops, insn, functions, top=1, force_deep=True).collect()}
    assert forced[3].route == "deep" and forced[3].errors == "no instructions,no functions"
    assert [r.func for r in job.most_blocks(insn, 1).collect()] == [10]
