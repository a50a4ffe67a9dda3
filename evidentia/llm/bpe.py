"""BPE encoding, long unsplit pieces by tree concatenation, and decoding, in Arrow batches inside tasks."""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from evidentia.llm.shared import python_workers

#: Texts are cut into parts of about this many characters; an unsplit piece that is longer is halved until its parts are not.
LEAF = 2048
#: Tokens on each side of a join in its first window.
FIRST_WINDOW = 16
#: Known pieces kept by a task's encoder; the table is emptied when full.
CACHE = 1_000_000

_LATIN = "A-Za-zÀ-ÖØ-öø-įı-ſ"
#: A character that no pre-tokenizer takes for white space, and such a one before a space or line end.
_SOLID = re.compile(r"[!-~\w]")
_SURE = re.compile(r"[!-~\w](?=[ \n])")
#: Characters outside these classes, and the start of a special token, send a part to the library whole.
_ODD = re.compile(rf"[^\t\n\r\x20-\x7e{_LATIN}]|<\|")
#: The pre-tokenizers of the two vocabularies for texts without odd characters.
BYTE_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LATIN}]+| ?[0-9]+| ?[^\s0-9{_LATIN}]+|\s+(?!\S)|\s+")
WORD_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LATIN}]+|[0-9]|[^\s0-9{_LATIN}]+")  # of lower-cased texts


class Encoder:
    """Encodes with the tokenizers library; pieces that its pre-tokenizer would cut out are looked up once and kept.

    Between pieces the vocabulary has no merges, so joining the pieces' ids gives the whole text's ids. ``pieces`` must cut texts without odd
    characters just as the library does; every other text goes to the library as it is.
    """

    def __init__(self, path: str, pieces: re.Pattern, lower: bool = False):
        """``lower``: the vocabulary lower-cases, drops white space, and marks the last token of each word."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.pieces, self.lower = pieces, lower
        self.known: dict[str, bytes] = {}
        self.ends = None
        if lower:
            self.ends = np.zeros(self.library.get_vocab_size(), bool)
            self.ends[[i for t, i in self.library.get_vocab().items() if t.endswith("</w>")]] = True

    def _ask(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _ask_pieces(self, pieces: list[str], at_once: int = 256) -> list[bytes]:
        """The ids of pieces; where words end with tokens of their own, many are asked in one text and cut apart again."""
        if self.ends is None:
            return self._ask(pieces)
        out: list[bytes] = []
        for k in range(0, len(pieces), at_once):
            some = pieces[k : k + at_once]
            ids = np.array(self.library.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(some) and cuts[-1] == len(ids):
                raw = ids.tobytes()
                out += [raw[4 * a : 4 * z] for a, z in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True)]
            else:
                out += self._ask(some)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        cut = [None if _ODD.search(t) else self.pieces.findall(t.lower() if self.lower else t) for t in texts]
        own = [pieces for pieces in cut if pieces is not None]
        missing = list(set().union(*own).difference(self.known))
        if len(self.known) + len(missing) > CACHE:
            self.known.clear()
            missing = list(set().union(*own))
        self.known.update(zip(missing, self._ask_pieces(missing), strict=True))
        whole = iter(self._ask([t for t, pieces in zip(texts, cut, strict=True) if pieces is None]))
        get = self.known.__getitem__
        return [next(whole) if pieces is None else b"".join(map(get, pieces)) for pieces in cut]


class TreeEncoder:
    """Encodes long texts in parts, and long unsplit pieces by tree concatenation: halves are encoded on their own, then joined bottom-up.

    A text is cut where a sure space follows a sure non-space: no piece of the pre-tokenizer goes over such a place, and nothing before it looks
    beyond it. A stretch longer than ``leaf`` without one is cut into special tokens and the pre-tokenizer's own pieces, so that what it sees ahead is what it
    sees in the text; a piece longer than ``leaf`` is halved until its parts are not. At a join the last tokens of the left part and the first of the right
    one are encoded again. If that window starts with the left part's own token and ends with the right part's own, both sides agree:
    inside one piece adjacent tokens of a byte-level BPE are valid or not whatever stands further away, so the window's tokens are those of the
    whole piece. Else the window doubles, up to both whole parts.
    """

    def __init__(self, encoder: Encoder, lengths: np.ndarray, leaf: int = LEAF, first: int = FIRST_WINDOW):
        self.encoder, self.lengths, self.leaf, self.first = encoder, lengths, leaf, first
        special = sorted((t.content for t in encoder.library.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None

    def _spans(self, text: str) -> Iterator[tuple[int, int]]:
        """Bounds of parts of ``text``, of at most ``leaf`` characters where places to cut allow."""
        i, n = 0, len(text)
        while n - i > self.leaf:
            j = text.rfind(" ", i + 1, i + self.leaf + 1)
            while j > i and not _SOLID.match(text, j - 1):
                j = text.rfind(" ", i + 1, j)
            if j <= i:
                found = _SURE.search(text, i + self.leaf)
                j = found.end() if found else n
            yield i, j
            i = j
        if i < n or not n:
            yield i, n

    def _pieces(self, text: str) -> list[tuple[str, bool]]:
        """Special tokens and the pre-tokenizer's pieces of ``text``, and whether each is too long."""
        out, at = [], 0
        for m in self.special.finditer(text) if self.special else ():
            out += [text[at : m.start()], m[0]]
            at = m.end()
        out.append(text[at:])
        cut = self.encoder.library.pre_tokenizer.pre_tokenize_str
        return [(p, k % 2 == 0 and len(p) > self.leaf) for k, part in enumerate(out) for p in ([part] if k % 2 else [part[a:z] for _, (a, z) in cut(part)])]

    def _join(self, jobs: list[tuple[bytes, np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        """Join (bytes of both parts, left ids, right ids); windows of one width are encoded together."""
        out: list = [None] * len(jobs)
        todo, width = list(range(len(jobs))), self.first
        while todo:
            asked = []
            for j in todo:
                raw, left, right = jobs[j]
                nl, nr = min(width, len(left)), min(width, len(right))
                a, z = (int(self.lengths[x].sum()) for x in (left[: len(left) - nl], right[nr:]))
                window = raw[a : len(raw) - z]
                split = window[0] & 0xC0 == 0x80 or (z and raw[len(raw) - z] & 0xC0 == 0x80)  # inside a character: the window grows
                asked.append((j, nl, nr, None if split else window.decode()))
            encoded = iter(self.encoder.encode([w for *_, w in asked if w is not None]))
            again = []
            for j, nl, nr, window in asked:
                _, left, right = jobs[j]
                ids = None if window is None else np.frombuffer(next(encoded), "<u4")
                if ids is not None and (nl == len(left) or ids[0] == left[len(left) - nl]) and (nr == len(right) or ids[-1] == right[nr - 1]):
                    out[j] = np.concatenate([left[: len(left) - nl], ids, right[nr:]])
                else:
                    again.append(j)
            todo, width = again, width * 2
        return out

    def _tree(self, pieces: list[str]) -> list[np.ndarray]:
        """Ids of long pieces: all leaves are encoded together, then each level's joins."""
        leaves = []
        for p in pieces:
            parts = 1
            while len(p) > parts * self.leaf:
                parts *= 2
            leaves.append([p[len(p) * i // parts : len(p) * (i + 1) // parts] for i in range(parts)])
        ids = iter(self.encoder.encode([x for own in leaves for x in own]))
        parts = [[(x.encode(), np.frombuffer(next(ids), "<u4")) for x in own] for own in leaves]
        while any(len(own) > 1 for own in parts):
            pairs = [(own[i], own[i + 1]) for own in parts if len(own) > 1 for i in range(0, len(own), 2)]
            joined = iter(self._join([(x[0] + y[0], x[1], y[1]) for x, y in pairs]))
            parts = [[(own[i][0] + own[i + 1][0], next(joined)) for i in range(0, len(own), 2)] if len(own) > 1 else own for own in parts]
        return [own[0][1] for own in parts]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        short: list[str] = []
        long: list[str] = []
        plan: list[list[tuple[bool, int]]] = []  # of each text: (is long, place among those)
        for t in texts:
            own = []
            for a, z in self._spans(t):
                for p, is_long in ((t[a:z], False),) if z - a <= self.leaf else self._pieces(t[a:z]):
                    kind = long if is_long else short
                    own.append((is_long, len(kind)))
                    kind.append(p)
            plan.append(own)
        done = (self.encoder.encode(short), [x.astype("<u4").tobytes() for x in self._tree(long)])
        return [np.frombuffer(b"".join(done[is_long][k] for is_long, k in own), "<u4") for own in plan]


def token_lengths(library) -> np.ndarray:
    """Bytes of each id of a byte-level vocabulary."""
    size = library.get_vocab_size(with_added_tokens=True)
    lengths = np.zeros(size, np.int64)
    special = {i for i, t in library.get_added_tokens_decoder().items()}
    for token, i in library.get_vocab(with_added_tokens=True).items():
        lengths[i] = len(token.encode()) if i in special else len(token)  # byte-level: one character a byte
    return lengths


def _utf8(value: bytes | None) -> str:
    return "" if value is None else value.decode("utf-8", "replace")


@functools.lru_cache(maxsize=8)  # a worker process keeps its encoders, and the pieces they know, for its next tasks
def byte_encoder(path: str, leaf: int = LEAF, first: int = FIRST_WINDOW) -> TreeEncoder:
    encoder = Encoder(path, BYTE_PIECES)
    return TreeEncoder(encoder, token_lengths(encoder.library), leaf, first)


@functools.lru_cache(maxsize=8)
def word_encoder(path: str) -> Encoder:
    return Encoder(path, WORD_PIECES, lower=True)


def batches(rows: Iterator[pa.RecordBatch], column: str, size: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches whose texts hold about ``size`` bytes, so that memory follows ``size`` and the longest text."""
    for batch in rows:
        values = batch.column(batch.schema.get_field_index(column)).to_pylist()
        start, held = 0, 0
        for i, v in enumerate(values):
            held += len(v or b"")
            if held >= size or i + 1 == len(values):
                yield batch.slice(start, i + 1 - start), [_utf8(x) for x in values[start : i + 1]]
                start, held = i + 1, 0


def encode_decode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids, decoded]) of every row; a null text counts as empty.

    Strings of special tokens in a text become those tokens, as the library does by default. Rows are independent: repeated rows, ties and
    null ids need no care, nothing is shuffled, and a lost executor costs only its own batches. An empty table gives no rows.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")

    python_workers(docs.sparkSession)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = byte_encoder(path)
        for batch, texts in batches(rows, "_text"):
            ids = tree.encode(texts)
            back = tree.encoder.library.decode_batch([x.tolist() for x in ids], skip_special_tokens=False)
            sha = lambda x: hashlib.sha256(x).hexdigest()
            out = [batch.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([sha(x.astype("<u4").tobytes()) for x in ids]), pa.array([sha(t.encode()) for t in back])]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                out += [pa.array([x.astype("i4") for x in ids], pa.list_(pa.int32())), pa.array(back, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(out, names)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("_text")).mapInArrow(run, schema)
