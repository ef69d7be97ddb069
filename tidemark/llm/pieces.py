"""SentencePiece encoding and decoding for vocabularies of the merge type.

A text is cut before every blank that follows another character; no piece of such a vocabulary reaches
over a cut, so each part is encoded by itself and remembered. Within a part, adjacent symbols whose
union is a piece wait in an agenda ordered by score, then by place.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

BLANK = "▁"
_PART = re.compile(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+")


def _cut(text: str) -> list[str]:
    """Parts of a text as it is encoded, each without its first blank: all parts begin with one."""
    if not text:
        return []
    if "  " in text or BLANK in text or text[0] == " " or text[-1] == " ":
        return [p[1:] for p in _PART.findall(BLANK + text.replace(" ", BLANK))]
    return text.split(" ")


#: Bytes of remembered parts, about, in two halves: when the newer is full, the older is forgotten.
_REMEMBERED = 128 << 20
#: What an entry takes besides its characters and ids.
_ENTRY = 200


def _code(i: int) -> bytes:
    return i.to_bytes(4, "little")


class Pieces:
    """A vocabulary, read through the sentencepiece library, and the encodings of the parts seen."""

    def __init__(self, path: str, checked: bool = True):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.checked = checked
        self.parts: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0
        size = self.library.get_piece_size()
        names = [self.library.id_to_piece(i) for i in range(size)]
        special = [self.library.is_control(i) or self.library.is_unknown(i) for i in range(size)]
        byte = [self.library.is_byte(i) for i in range(size)]
        self.ids = {n: i for i, n in enumerate(names) if not (special[i] or byte[i])}
        self.cost = {n: -self.library.get_score(i) for n, i in self.ids.items()}
        self.codes = {n: _code(i) for n, i in self.ids.items()}
        self.unknown = _code(self.library.unk_id())
        self.bytes = {int(names[i][1:-1], 16): _code(i) for i in range(size) if byte[i]}
        self.raw = [b"" if special[i] else bytes([int(names[i][1:-1], 16)]) if byte[i] else names[i].replace(BLANK, " ").encode() for i in range(size)]
        if any(BLANK in n.lstrip(BLANK) for n in self.ids):
            raise ValueError("pieces of this vocabulary reach over blanks")
        sample = "a  Åﬁ "
        if self.library.encode(sample) != array("I", self.encode([sample], False, False)[0]).tolist():
            raise ValueError("the vocabulary rewrites texts or is not of the merge type")

    def symbols(self, part: str) -> list[str]:
        """Symbols left when no adjacent pair of ``part`` is a piece any more."""
        symbols, cost = list(part), self.cost
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = [(c, i, i + 1, 2) for i in range(n - 1) if (c := cost.get(symbols[i] + symbols[i + 1])) is not None]
        heapq.heapify(agenda)
        while agenda:
            _, i, j, size = heapq.heappop(agenda)
            left, right = symbols[i], symbols[j]
            if not left or not right or len(left) + len(right) != size:
                continue
            symbols[i], symbols[j] = left + right, ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (c := cost.get(symbols[i] + symbols[k])) is not None:
                    heapq.heappush(agenda, (c, i, k, size + len(symbols[k])))
            k = before[i]
            if k >= 0 and (c := cost.get(symbols[k] + symbols[i])) is not None:
                heapq.heappush(agenda, (c, k, i, size + len(symbols[k])))
        return [s for s in symbols if s]

    def encoded(self, part: str) -> bytes:
        """Ids of a part as little-endian 32-bit integers; runs of unknown characters share one id."""
        found: list[bytes] = []
        for s in self.symbols(part):
            code = self.codes.get(s)
            if code is not None:
                found.append(code)
            elif self.bytes:
                found += [self.bytes[b] for b in s.encode()]
            elif not found or found[-1] != self.unknown:
                found.append(self.unknown)
        return b"".join(found)

    def encode(self, texts: list[str], begin: bool = True, end: bool = True) -> list[bytes]:
        """Ids of every text as little-endian 32-bit integers.

        With ``checked`` every part not met before is encoded by the library too; a difference is an error.
        """
        cut = [_cut(t) for t in texts]
        parts = self.parts
        wanted = set().union(*cut) - parts.keys()
        again = wanted & self.older.keys()
        fresh = list(wanted - again)
        found = [self.encoded(BLANK + p) for p in fresh]
        if self.checked:
            self._compare(fresh, found)
        parts.update(zip(fresh, found))
        parts.update((p, self.older[p]) for p in again)
        self.held += sum(len(p) + len(parts[p]) + _ENTRY for p in wanted)
        first = _code(self.library.bos_id()) if begin else b""
        last = _code(self.library.eos_id()) if end else b""
        result = [first + b"".join([parts[p] for p in own]) + last for own in cut]
        if self.held > _REMEMBERED // 2:
            self.older, self.parts, self.held = (parts, {}, 0) if self.held <= _REMEMBERED else ({}, {}, 0)
        return result

    def _compare(self, parts: list[str], found: list[bytes]) -> None:
        """Raise if the library encodes a part otherwise. A part that is empty stands for a lone blank."""
        other = self.library.encode([p.replace(BLANK, " ") or BLANK for p in parts], num_threads=1)
        for part, own, ids in zip(parts, found, other):
            theirs = array("I", ids).tobytes() if part else _code(self.library.piece_to_id(BLANK))
            if own != theirs:
                raise ValueError(f"the library encodes {part!r} as {ids}, not as {array('I', own).tolist()}")

    def decode(self, rows: list[np.ndarray]) -> list[str]:
        """Texts of rows of ids. Control ids vanish; the blank put before a text is taken off again.

        With ``checked`` the library must give the same. Byte pieces that are no UTF-8 are left to it.
        """
        if not rows:
            return []
        texts = []
        for row in rows:
            try:
                text = b"".join([self.raw[i] for i in row.tolist()]).decode()
                texts.append(text[1:] if text.startswith(" ") else text)
            except UnicodeDecodeError:
                texts.append(self.library.decode(row.tolist()))
        if self.checked and texts != self.library.decode([row.tolist() for row in rows], num_threads=1):
            raise ValueError("the library decodes a row of ids otherwise")
        return texts


@lru_cache(maxsize=2)
def pieces(path: str, checked: bool = True) -> Pieces:
    """The vocabulary at ``path``, loaded once per worker."""
    return Pieces(path, checked)


def _runs(texts: pa.Array, size: int = 1 << 19) -> Iterator[list[str]]:
    """Texts in runs of about ``size`` characters, none of them empty."""
    run, held = [], 0
    for text in texts:
        run.append(text.as_py() or "")
        held += len(run[-1])
        if held >= size:
            yield run
            run, held = [], 0
    if run:
        yield run


def encode(text: Column, path: str, begin: bool = True, end: bool = True, checked: bool = True) -> Column:
    """Ids of a text as an array; a null text is an empty one."""

    @arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = [row for run in _runs(texts) for row in pieces(path, checked).encode(run, begin, end)]
            places = np.concatenate([[0], np.cumsum([len(r) // 4 for r in rows], dtype=np.int64)]).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(places), pa.array(np.frombuffer(b"".join(rows), "<i4")))

    return ids(text)


def decode(ids: Column, path: str, checked: bool = True) -> Column:
    """Text of an array of ids; a null or empty array gives an empty text."""

    @arrow_udf("string")
    def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for rows in batches:
            yield pa.array(pieces(path, checked).decode([np.array(r.as_py() or [], np.int64) for r in rows]), pa.string())

    return texts(ids)


def round_trip(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", checked: bool = True) -> DataFrame:
    """One row (doc_id, n_tokens, ids_sha256, decoded_sha256) per row of ``docs``; other columns are ignored.

    Texts are encoded with begin and end ids, the ids decoded again, both in the same Arrow batch, so that
    no array of ids leaves the worker. Null texts are empty.
    """

    @arrow_udf("n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    def digests(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            counts, ids, decoded = [], [], []
            for run in _runs(texts):
                rows = pieces(path, checked).encode(run)
                counts += [len(r) // 4 for r in rows]
                ids += [hashlib.sha256(r).hexdigest() for r in rows]
                back = pieces(path, checked).decode([np.frombuffer(r, "<u4") for r in rows])
                decoded += [hashlib.sha256(t.encode()).hexdigest() for t in back]
            yield pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(doc_id).alias("doc_id"), digests(F.col(text)).alias("found")).select("doc_id", "found.*")
