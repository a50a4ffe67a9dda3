"""Executables, dictionary files, fused evidence, key windows, cached answers and stored batches, against plain Python and planted files."""

from __future__ import annotations

import json
import math
import random
import struct
import uuid
from datetime import datetime
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evidentia.functions import adapter
from evidentia.operators import evidence, scan
from evidentia.plans import catalogue, findings, fusion
from evidentia.sources import dictionaries, executables
from evidentia.streaming import answers, batches

SF = "/root/testdata/sf0.001"


def elf(wide: bool, order: str, machine: int) -> bytes:
    """Header, one .text of 8 bytes and the names, then the section table."""
    names = b"\0.text\0.shstrtab\0"
    start = 64 if wide else 52
    table = start + 8 + len(names)
    ident = b"\x7fELF" + bytes([2 if wide else 1, 1 if order == "<" else 2, 1]) + bytes(9)
    head = struct.pack(order + ("HHIQQQIHHHHHH" if wide else "HHIIIIIHHHHHH"), 2, machine, 1, 0x4010, 0, table, 0, start, 0, 0, 64 if wide else 40, 3, 2)
    row = lambda name, kind, addr, off, size: struct.pack(order + ("IIQQQQIIQQ" if wide else "IIIIIIIIII"), name, kind, 0, addr, off, size, 0, 0, 0, 0)
    return ident + head + b"ABCDEFGH" + names + row(0, 0, 0, 0, 0) + row(1, 1, 0x4000, start, 8) + row(7, 3, 0, start + 8, len(names))


def pe(wide: bool, machine: int) -> bytes:
    optional = bytearray(112 if wide else 96)
    struct.pack_into("<H", optional, 0, 0x20B if wide else 0x10B)
    struct.pack_into("<I", optional, 16, 0x1010)
    struct.pack_into("<Q" if wide else "<I", optional, 24 if wide else 28, 0x400000)
    head = b"MZ" + bytes(58) + struct.pack("<I", 64) + b"PE\0\0" + struct.pack("<HHIIIHH", machine, 1, 0, 0, 0, len(optional), 0)
    data = len(head) + len(optional) + 40
    return head + bytes(optional) + struct.pack("<8sIIIIIIHHI", b".text", 6, 0x1000, 8, data, 0, 0, 0, 0, 0) + b"ABCDEFGH"


def macho(wide: bool, order: str, machine: int) -> bytes:
    magic = {("<", False): b"\xce\xfa\xed\xfe", ("<", True): b"\xcf\xfa\xed\xfe", (">", False): b"\xfe\xed\xfa\xce", (">", True): b"\xfe\xed\xfa\xcf"}[order, wide]
    segment, section, start = (72, 80, 32) if wide else (56, 68, 28)
    data = start + segment + 2 * section + 24
    out = magic + struct.pack(order + "IIIIII", machine, 0, 2, 2, segment + 2 * section + 24, 0) + (bytes(4) if wide else b"")
    out += struct.pack(order + "II16s" + ("QQQQ" if wide else "IIII") + "IIII", 0x19 if wide else 1, segment + 2 * section, b"__TEXT", 0x1000, 64, 0, 64, 7, 5, 2, 0)
    for name, size, flags in ((b"__text", 8, 0), (b"__bss", 99, 1)):
        tail = (data, 0, 0, 0, flags, 0, 0) + ((0,) if wide else ())
        out += struct.pack(order + "16s16s" + ("QQ" if wide else "II") + "I" * len(tail), name, b"__TEXT", 0x1040, size, *tail)
    return out + struct.pack(order + "IIQQ", 0x80000028, 24, 0x40, 0) + b"ABCDEFGH"


PLANTED = {
    "elf64": (elf(True, "<", 62), ("unix", "x86_64", 0x4010, 64, "LE"), ".text", 0x4000),
    "elf32be": (elf(False, ">", 8), ("unix", "mips", 0x4010, 32, "BE"), ".text", 0x4000),
    "pe64": (pe(True, 0x8664), ("windows", "x86_64", 0x401010, 64, "LE"), ".text", 0x401000),
    "pe32": (pe(False, 0x14C), ("windows", "i386", 0x401010, 32, "LE"), ".text", 0x401000),
    "macho64": (macho(True, "<", 0x0100000C), ("darwin", "aarch64", 0x1040, 64, "LE"), "__TEXT,__text", 0x1040),
    "macho32be": (macho(False, ">", 12), ("darwin", "arm", 0x1040, 32, "BE"), "__TEXT,__text", 0x1040),
}


def test_executables_of_each_kind_and_cut_off_ones(spark):
    names = list(PLANTED)
    fat = executables.FAT_MAGIC + struct.pack(">IIIIII", 1, 0x0100000C, 0, 28, 0, 0) + PLANTED["macho64"][0]
    odd = {"blob": b"no magic here", "java": executables.FAT_MAGIC + b"\0\0\0\x34rest", "none": None, "empty": b"", "dos": b"MZ" + bytes(70), "fat": fat}
    rows = [(i, n, bytearray(PLANTED[n][0])) for i, n in enumerate(names)] + [(100 + i, n, bytearray(PLANTED[n][0][:-6] if n.startswith(("pe", "macho")) else PLANTED[n][0][:-30])) for i, n in enumerate(names)]
    rows += [(200 + i, n, None if c is None else bytearray(c)) for i, (n, c) in enumerate(odd.items())]
    files = spark.createDataFrame(rows, "file_id long, filename string, content binary")
    got = {r["file_id"]: r for r in executables.loaded(files).collect()}
    parts = {}
    for r in executables.sections_of(files).collect():
        parts.setdefault(r["file_id"], {})[r["name"]] = r
    assert len(got) == len(rows)
    for i, n in enumerate(names):
        _, head, section, address = PLANTED[n]
        assert (tuple(got[i][c] for c in ("os", "arch", "entry", "bits", "endian")), got[i]["error"]) == (head, None)
        # what pads a PE section in the file, beyond its size in memory, is not part of it
        assert (bytes(parts[i][section]["data"]), parts[i][section]["vaddr"]) == (b"ABCDEF" if n.startswith("pe") else b"ABCDEFGH", address)
        assert got[100 + i]["error"] and got[100 + i]["arch"] is None and 100 + i not in parts, n
    assert parts[4]["__TEXT,__bss"]["memsize"] == 99 and not parts[4]["__TEXT,__bss"]["data"]
    by = {n: got[200 + i] for i, n in enumerate(odd)}
    assert [by[n]["arch"] for n in odd] == ["x86_64", "x86_64", None, "x86_64", None, "aarch64"]
    assert by["none"]["error"] == "no content" and by["dos"]["error"] and by["blob"]["os"] == "unknown"
    assert bytes(parts[205]["__TEXT,__text"]["data"]) == b"ABCDEFGH"


def test_blobs_take_the_first_architecture_that_fits():
    assert executables.decoded(b"x", lambda d, a: a in ("mips", "arm"))[0][1] == "arm"
    assert executables.decoded(b"x", lambda d, a: False)[2] == "no architecture fits"


def test_dictionary_files_of_any_shape(spark, tmp_path):
    shape = {"aes": {"rcon": [1, 2], "block": 128, "name": "x", "nested": {"a": 1}}, "sha": {"h": ["0x6a09e667", "0xFFFFFFFFFFFFFFFF", "zz"], "empty": []}, "none": {}}
    (tmp_path / "d.json").write_text(json.dumps(shape, indent=1))
    got = {(r["family"], r["field"], r["pos"]): (r["text"], None if r["number"] is None else int(r["number"])) for r in dictionaries.entries(dictionaries.dictionary(spark, str(tmp_path / "d.json"))).collect()}
    assert got == {
        ("aes", "rcon", 0): ("1", 1), ("aes", "rcon", 1): ("2", 2), ("aes", "block", 0): ("128", 128), ("aes", "name", 0): ("x", None), ("aes", "nested", 0): ('{"a":1}', None),
        ("sha", "h", 0): ("0x6a09e667", 0x6A09E667), ("sha", "h", 1): ("0xFFFFFFFFFFFFFFFF", 2**64 - 1), ("sha", "h", 2): ("zz", None),
    }
    assert dictionaries.entries(spark.createDataFrame([("not json",), (None,)], "value string")).count() == 0
    more = {"architectures": {"Z": {"crypto_extensions": {"E": {"instructions": ["Q"], "patterns": [{"name": "P", "instructions": ["a", "B"], "confidence": 0.9}]}, "F": {"instructions": []}}}}}
    assert {tuple(r) for r in dictionaries.isa_table(dictionaries.inline(spark, more)).collect()} == {("Z", "P", "A", 1, 0.9), ("Z", "P", "B", 1, 0.9)}
    assert dictionaries.isa_table(dictionaries.inline(spark, dictionaries.ISA)).count() == sum(len(p["instructions"]) for a in dictionaries.ISA["architectures"].values() for p in a["common_crypto_patterns"].values())
    assert dictionaries.boost_table(dictionaries.inline(spark, dictionaries.INDICATORS)).count() == 18


def test_fusion_with_nulls_ties_and_strange_sources(spark):
    rows = [(1, "AES", "name", 0.9), (1, "AES", "inferred", 0.5), (1, "AES", "inferred", 0.8), (1, "DES", "rumour", 1.0), (1, "MD5", "string", None), (2, "AES", "constant", 7.0), (2, None, "name", 1.0), (2, "RC4", None, 0.5)]
    names = [(1, "SSL_write SSL_write recv"), (1, "ECDH"), (2, None), (None, "send"), (3, "session")]
    terms = dictionaries.boost_table(dictionaries.inline(spark, dictionaries.INDICATORS))
    raised = evidence.boosts(spark.createDataFrame(names, "file_id long, text string"), terms)
    assert {tuple(r) for r in raised.collect()} == {(1, 0.7, "key_exchange,network_communication"), (3, 0.2, "session_management")}
    frame = spark.createDataFrame(rows, "file_id long, algorithm string, source string, confidence double")
    got = {(r["file_id"], r["algorithm"]): tuple(r)[2:] for r in evidence.fused(frame, raised).collect()}
    assert got == {(1, "AES"): ("inferred", 2, 0.99), (1, "DES"): ("other", 1, 0.7), (1, "MD5"): ("string", 1, 0.7), (2, "AES"): ("constant", 1, 0.9), (2, "RC4"): ("other", 1, 0.0)}
    assert evidence.fused(frame.limit(0), raised.limit(0)).count() == 0


@pytest.mark.parametrize("name,hint,want", [("AES-256", "aes_gcm_encrypt", ("block", "GCM", 256, 128, True)), ("aes", "the ECB mode", ("block", "ECB", None, 128, False)), ("SHA3-256", None, ("sponge", None, None, None, None)), ("RC4", "cbc", ("stream", None, None, None, None)), ("SHA-512", "", (None,) * 5), (None, None, (None,) * 5)])
def test_cipher_traits(spark, name, hint, want):
    row = spark.createDataFrame([(name, hint)], "a string, h string").select(evidence.cipher_traits(F.col("a"), F.regexp_replace("h", "_", " ")).alias("t")).first()["t"]
    assert tuple(row) == want


def plain_keys(data: bytes) -> dict[int, tuple[int, str]]:
    found = {}
    for size in (32, 24, 16, 8):
        for o in range(len(data) - size):
            w = data[o : o + size]
            spread = -sum(w.count(c) / size * math.log2(w.count(c) / size) for c in set(w))
            public = any(w.hex().startswith(p) for p in scan.PUBLIC_PREFIXES) or any(c in w.hex()[i:] and w.hex().find(c, i) % 2 == 0 for c in scan.PUBLIC_CONSTANTS for i in range(0, 2 * size, 2))
            if sum(b < 32 or b > 126 for b in w) >= size * 0.3 and spread >= 3 - 1e-9 and not public:
                found[o] = (size, w.hex())
    return found


def test_key_windows_are_those_of_plain_python(spark):
    r = random.Random(9)
    blobs = [bytes(r.choice([0, 1, 65, 200, 201, 202, 203, 250, r.randrange(256)]) for _ in range(n)) for n in (0, 8, 9, 31, 32, 33, 200)]
    blobs += ["Ünïcödé wörds, ïn á lïné, ànd möré ôf thém — “quoted” ".encode() * 3, bytes.fromhex("6a09e667") + bytes(range(128, 150))]
    frame = spark.createDataFrame([(i, ".data", 1000, bytearray(b)) for i, b in enumerate(blobs)] + [(98, ".text", 0, bytearray(range(200))), (99, ".data", 0, None)], "file_id long, name string, vaddr long, data binary")
    got = {(x["file_id"], x["offset"] - 1000): (x["size"], x["hexed"]) for x in scan.key_windows(frame).collect()}
    assert got == {(i, o): v for i, b in enumerate(blobs) for o, v in plain_keys(b).items()}
    assert {v[0] for v in got.values()} >= {8, 16}


@pytest.mark.parametrize("step", [1, 7, 64, None])
def test_key_windows_of_a_whole_batch_at_any_step(step):
    r = random.Random(4)
    constants = [bytes.fromhex(c) for c in (*scan.PUBLIC_CONSTANTS, *scan.PUBLIC_PREFIXES)]
    blobs = [bytes(r.choice([1, 65, 200, 201, 202, 203, r.randrange(256)]) for _ in range(r.randrange(60))) + (r.choice(constants) + r.randbytes(r.randrange(40)) if i % 3 == 0 else b"") for i in range(60)]
    blobs[5:5] = [None, b"", None]
    data = pa.array([b"cut off", *blobs, b"too"], pa.binary())[1:-1]
    got = {}
    for rows, starts, sizes, packed in scan._key_like(data, list(scan.KEY_SIZES), step):
        for i, o, size in zip(rows.tolist(), starts.tolist(), sizes.tolist(), strict=True):
            assert (i, o) not in got
            got[i, o], packed = (size, packed[:size].hex()), packed[size:]
    assert got == {(i, o): v for i, b in enumerate(blobs) for o, v in plain_keys(b or b"").items()} and {v[0] for v in got.values()} == set(scan.KEY_SIZES)


@pytest.mark.parametrize("bound", [0, 100])
def test_only_sections_that_can_overlap_are_grouped(spark, monkeypatch, bound):
    """Windows of a file's only section of a name go out as they are; sections that overlap give each offset once, with its smallest window."""
    monkeypatch.setattr(scan, "SEVERAL", bound)
    schema = "file_id long, name string, vaddr long, data binary"
    one, two = random.Random(1).randbytes(60), b"\x01" * 8 + random.Random(2).randbytes(60)
    single = spark.createDataFrame([(1, ".data", 0, bytearray(one)), (1, ".rodata", 0, bytearray(one)), (2, ".data", 5, None), (None, ".data", 0, bytearray(two))], schema)
    found = scan.key_windows(single)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "hashpartitioning" not in plan
    assert found.count() == 2 * len(plain_keys(one)) + len(plain_keys(two))
    rows = [(f, ".data", v, bytearray(d)) for f in (7, None) for v, d in ((100, one), (110, two))] + [(8, ".data", 100, bytearray(two))]
    got = [(x["file_id"], x["offset"], x["size"]) for x in scan.key_windows(spark.createDataFrame(rows, schema)).collect()]
    want = {}
    for f, _, v, d in rows:
        for o, (size, _) in plain_keys(bytes(d)).items():
            want[f, v + o] = min(size, want.get((f, v + o), 99))
    assert sorted(map(repr, got)) == sorted(repr((*k, size)) for k, size in want.items())


@pytest.mark.skipif(not Path(SF).is_dir(), reason="no driver tables")
def test_keys_of_a_table_of_one_row_group_are_searched_in_many_tasks(spark):
    found = catalogue.key_candidates(spark, SF)
    assert found.select(F.spark_partition_id()).distinct().count() == spark.sparkContext.defaultParallelism
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "sha2" not in plan[plan.index("Exchange") :]


@pytest.mark.skipif(not Path(SF).is_dir(), reason="no driver tables")
def test_first_keys_are_cut_before_their_only_exchange(spark):
    """Windows are not grouped by offset first, and of a file's windows a task gives out ten at most."""
    plan = findings.first_keys(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "min_by" not in plan and "Partial" in plan[plan.index("WindowGroupLimit") :]
    found = {}
    for x in catalogue.key_candidates(spark, SF).collect():
        found.setdefault(x["file_id"], []).append((x["offset"], x["size"], x["hexed"]))
    want = {(f, o + 1, *v, len(rows)) for f, rows in found.items() for o, v in enumerate(sorted(rows)[:10])}
    got = [(x["file_id"], x["ord"], x["offset"], x["size"], x["hexed"], x["total_found"]) for x in findings.first_keys(spark, SF).collect()]
    assert set(got) == want and len(got) == len(want)


@pytest.mark.skipif(not Path(SF).is_dir(), reason="no driver tables")
def test_first_keys_of_files_of_one_section_are_searched_once_and_not_exchanged(spark):
    found = findings.first_keys(spark, SF)
    found.collect()
    final = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("MapInArrow") == 1 and "Window" not in final and "Exchange" not in final[: final.index("MapInArrow")]


@pytest.mark.parametrize("step", [50, 1 << 16])
@pytest.mark.parametrize("names", [(".data", ".rodata"), (".data", ".data")])
def test_first_keys_of_any_sections(spark, monkeypatch, names, step):
    """Files of one section and of several, of one name or not, long rows and null ids: the first ten of all windows, and the count of all."""
    monkeypatch.setattr(scan, "_key_like", lambda data, sizes, f=scan._key_like: f(data, sizes, step))
    r = random.Random(7)
    rows = [(1, ".data", 0, r.randbytes(300)), (2, ".data", 0, None), (3, ".data", 9, r.randbytes(12)), (4, ".text", 0, r.randbytes(50)), (5, ".rodata", 7, b"\x01" * 70 + r.randbytes(80)), (6, ".data", 0, b"")]
    rows += [(f, name, v, r.randbytes(n)) for f in (8, None) for name, v, n in zip(names, (100, 112), (15, 60), strict=True)] + [(9, ".data", 0, r.randbytes(40)), (9, ".text", 0, r.randbytes(40))]
    sections = spark.createDataFrame([(f, n, v, d if d is None else bytearray(d)) for f, n, v, d in rows], "file_id long, name string, vaddr long, data binary")
    found = {}
    for f, n, v, d in rows:
        for o, (size, hexed) in plain_keys(d or b"").items() if n != ".text" else ():
            at = found.setdefault(f, {})
            at[v + o, n] = min((size, hexed), at.get((v + o, n), (99, "")))
    want = [(f, n, o, *k, i + 1, len(at)) for f, at in found.items() for i, ((o, n), k) in enumerate(sorted(at.items())[:10])]
    got = scan.first_key_windows(sections)
    assert got.filter("NOT has_hardcoded_keys OR key_type IS NULL").isEmpty()
    assert sorted(map(repr, want)) == sorted(repr(tuple(x)) for x in got.select("file_id", "section", "offset", "size", "hexed", "ord", "total_found").collect())
    assert {f for f, *_ in want} == {1, 3, 5, 8, 9, None} and max(x[-1] for x in want) > 200


def test_keys_of_whole_texts(spark, tmp_path):
    texts = [(0, "plain words only " * 50), (1, "é" * 40), (2, "αβγδεζηθικλμνξοπρστυφχψω ünd ñandú çédille " * 4), (3, None), (4, "")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(x["file_id"], x["offset"]): (x["size"], x["hexed"]) for x in fusion.text_keys(spark, str(tmp_path)).collect()}
    assert got == {(i, o): v for i, t in texts for o, v in plain_keys((t or "").encode()).items()} and got


def test_keys_of_whole_texts_are_not_exchanged(spark, tmp_path):
    spark.createDataFrame([(i, "é" * i) for i in range(9)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    plan = fusion.text_keys(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan and "Aggregate" not in plan


def test_texts_of_one_row_group_are_searched_in_many_tasks(spark, tmp_path, monkeypatch):
    """One file of one row group is read by one task: its texts are dealt out, with the same windows; a table of even tasks is left as it is."""
    monkeypatch.setattr(fusion, "KEY_DOCUMENTS", 50)
    texts = [(i, f"{'é' * (i % 40)} αβγδεζηθικλμνξοπρστυφχψω {i}") for i in range(400)]
    for name, parts in (("one", 1), ("many", 8)):
        spark.createDataFrame(texts, "doc_id long, text string").repartition(parts).write.parquet(str(tmp_path / name / "documents.parquet"))
    one, many = (fusion.text_keys(spark, str(tmp_path / name)) for name in ("one", "many"))
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(one) == rows(many) and one.count() == sum(len(plain_keys(t.encode())) for _, t in texts) > 400
    assert one.select(F.spark_partition_id()).distinct().count() >= spark.sparkContext.defaultParallelism
    assert "Exchange" not in many._jdf.queryExecution().executedPlan().toString()


def test_each_key_is_asked_once_and_live_entries_never(spark, tmp_path):
    folder = str(tmp_path)

    def client(model: str, prompt: str) -> tuple[str, int, int]:
        Path(folder, f"{prompt}-{uuid.uuid4().hex}").touch()
        if prompt == "bad":
            raise ValueError("no")
        return prompt.upper(), 1, 1

    rows = [(1, "a", "m", "a"), (2, "a", "m", "a"), (3, "b", "m", "b"), (4, "old", "m", "old"), (5, "x", "m", "bad"), (6, None, "m", "n"), (7, None, "m", "n"), (8, "a", "m", "a")]
    requests = spark.createDataFrame(rows, "id long, key string, model string, prompt string")
    cache = spark.createDataFrame([("b", "held", 950, 100), ("old", "gone", 800, 100), ("b", "older", 900, 100)], "key string, value string, ts long, ttl int")
    answers, entries = adapter.answered(requests, cache, client, F.lit(1000), retries=1, pause=0.0)
    for _ in range(2):  # a second action asks nobody
        got = {r["id"]: (r["content"], r["success"], r["cached"]) for r in answers.collect()}
    assert got == {1: ("A", True, False), 2: ("A", True, False), 8: ("A", True, False), 3: ("held", True, True), 4: ("OLD", True, False), 5: (None, False, False), 6: ("N", True, False), 7: ("N", True, False)}
    assert sorted((r["key"], r["value"], r["ts"]) for r in entries.collect()) == [("a", "A", 1000), ("old", "OLD", 1000)]
    calls = sorted(p.name.split("-")[0] for p in Path(folder).iterdir())
    assert calls == ["a", "bad", "bad", "n", "n", "old"]


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "table")
    schema = "k string, v double"
    for i in range(5):
        spark.createDataFrame([("a", float(i)), ("b", 1.0), (None, None)], schema).coalesce(1).write.mode("append").parquet(str(source))
    change = lambda df: batches.partial_totals(df, ["k"], "v")
    run = lambda: batches.start_batches(spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(str(source)), out, str(tmp_path / "state"), change).awaitTermination()
    totals = lambda: sorted(map(repr, map(tuple, batches.merged_totals(spark.read.parquet(out), ["k"]).collect())))
    run()
    want = ["('a', 5, 10.0)", "('b', 5, 5.0)", "(None, 5, None)"]
    assert totals() == want
    # the driver died after the write and before the stream noted it: the last batch comes again
    commits = [p for p in (tmp_path / "state" / "commits").iterdir() if p.name.isdigit()]
    last = max(commits, key=lambda p: int(p.name))
    for p in (last, last.with_name(f".{last.name}.crc")):
        p.unlink(missing_ok=True)
    run()
    assert totals() == want
    spark.createDataFrame([("c", 2.5)], schema).write.mode("append").parquet(str(source))
    run()
    assert totals() == sorted([*want, "('c', 1, 2.5)"])


def _asked(requests, ttl):
    """Plain Python: hit and entry of requests (id, key, seconds) in order of arrival."""
    live, out = {}, []
    for i, k, t in requests:
        if k is None or not t:
            out.append((i, k, False, None))
            continue
        hit = k in live and t - live[k][0] <= ttl
        if not hit:
            live[k] = (t, i)
        out.append((i, k, hit, live[k][1]))
    return out


def test_cache_in_a_stream_equals_plain_python(spark, tmp_path):
    """Three runs of one stream, the state kept between them; ties, the last moment of an entry, null keys and times, a hot key."""
    source, out, draw = tmp_path / "in", str(tmp_path / "out"), random.Random(5)
    parts = [
        [(0, "a", 1), (1, "a", 60), (2, "a", 60), (3, "b", 10), (4, None, 10), (5, "c", None), (400, "c", 0)],
        [(6, "a", 101), (7, "a", 102), (8, "b", 130), (9, None, 131), *((10 + i, "a", 140 + i // 3) for i in range(300))],
        [(1000 + i, draw.choice("aaab"), 260 + i // 4) for i in range(2000)],
    ]
    schema = "id long, key string, at long"
    for rows in parts:
        df = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("at")).drop("at")
        df.coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(df.schema).parquet(str(source)).withColumn("hit", F.lit("x"))
        batches.start_batches(answers.cached_requests(stream, ttl=100, late="5 seconds"), out, str(tmp_path / "state")).awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(out).select("id", "key", "hit", "entry_id").collect()}
    assert got == set(_asked([r for rows in parts for r in rows], 100))
    assert spark.read.parquet(out).count() == sum(map(len, parts))


def test_cache_in_a_stream_of_nothing_and_of_equal_times(spark, tmp_path):
    source, schema = tmp_path / "in", "id string, key long, ts timestamp"
    run = lambda: batches.start_batches(answers.cached_requests(spark.readStream.schema(schema).parquet(str(source)), ttl=0), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    spark.createDataFrame([], schema).coalesce(1).write.parquet(str(source))
    run()
    spark.sql("SELECT CAST(id AS STRING) AS id, 7L AS key, TIMESTAMP'2024-01-01' AS ts FROM range(5)").coalesce(1).write.mode("append").parquet(str(source))
    run()
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("id", "key", "hit", "entry_id").collect())
    assert got == [("0", 7, False, "0"), *((str(i), 7, True, "0") for i in range(1, 5))]


@pytest.mark.parametrize("kind,key", [("string", lambda n: f"k{n}"), ("double", lambda n: n - 20.0), ("binary", lambda n: bytearray([255, n])), ("timestamp", lambda n: datetime(2024, 1, 1, microsecond=n))])
def test_cache_in_a_stream_keeps_many_keys_in_few_rows_of_state(spark, tmp_path, kind, key):
    """Keys share buckets and are judged apart; their entries outlive a run, and go when the watermark has passed their ends, with or without new rows."""
    source, out, draw = tmp_path / "in", str(tmp_path / "out"), random.Random(8)
    parts = [[(1000 * p + i, draw.randrange(40), start + i // 3) for i in range(500)] for p, start in enumerate((1, 170))] + [[(9000, 7, 10_000)]]
    schema = f"id long, key {kind}, at long"
    for rows in parts:
        df = spark.createDataFrame([(i, key(k), t) for i, k, t in rows], schema).withColumn("ts", F.timestamp_seconds("at")).drop("at")
        df.coalesce(1).write.mode("append").parquet(str(source))
        asked = answers.cached_requests(spark.readStream.schema(df.schema).parquet(str(source)), ttl=50, late="5 seconds", buckets=3)
        run = batches.start_batches(asked, out, str(tmp_path / "state"))
        run.awaitTermination()
        assert 0 < run.lastProgress.stateOperators[0].numRowsTotal <= (3 if rows[0][0] < 9000 else 1)
    native = lambda v: bytes(v) if kind == "binary" else v
    got = [(x["id"], native(x["key"]), x["hit"], x["entry_id"]) for x in spark.read.parquet(out).collect()]
    want = [(i, native(key(k)), hit, e) for i, k, hit, e in _asked([r for rows in parts for r in rows], 50)]
    assert sorted(got) == sorted(want)
