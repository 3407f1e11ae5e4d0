"""Byte-pair encoding by per-prefix dynamic programming, and decoding.

For every prefix of a piece of text exactly one token can be the last of its encoding. Going through the prefixes by
length, the candidates for a prefix are the vocabulary entries that end there (an automaton over the vocabulary gives
them all in one pass); the right one starts at 0, or fits behind the last token of the prefix it leaves. Two tokens fit
if no merge across their border would have come before the merges that built them. The back-pointers give the ids.

Pieces repeat a lot, and each Python worker keeps the encodings of the latest ones in a table of bounded size.

Nulls count as empty text: no tokens, the hash of nothing. Repeated rows and ties need no rule, each row stands alone.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Callable

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.common import small_batches

#: Fixed values of the byte-level format: the pattern of pieces, and the printable stand-ins of bytes.
PIECES = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
          r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
#: The same pattern for texts of signs below U+0100, with the letters, numbers and spaces among them spelt out.
NARROW = (r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff]+| ?[0-9\xb2\xb3\xb9\xbc-\xbe]+"
          r"| ?[^\t-\r \x85\xa0A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff0-9\xb2\xb3\xb9\xbc-\xbe]+"
          r"|[\t-\r \x85\xa0]+(?![^\t-\r \x85\xa0])|[\t-\r \x85\xa0]+")
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]

#: Entries of one generation of a table in a Python worker; a table holds two generations.
KEPT = 250_000


def byte_of_sign() -> dict[str, int]:
    table = {chr(b): b for b in PRINTABLE}
    rest = [b for b in range(256) if b not in PRINTABLE]
    return table | {chr(256 + i): b for i, b in enumerate(rest)}


class Latest(dict):
    """key -> make(key), computed once while the key stays in use.

    Holds two generations of at most ``KEPT`` keys: a full one becomes the older one, and what is asked for again moves
    to the younger one.
    """

    def __init__(self, make: Callable):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= KEPT:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class Encoder:
    """Encoder and decoder of one vocabulary file in the byte-level BPE format."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        signs = byte_of_sign()
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        ids = {}
        for token, number in vocab.items():
            if token not in self.special:
                raw = bytes(signs[c] for c in token)
                self.bytes_of[number], ids[raw] = raw, number
        for token, number in self.special.items():
            self.bytes_of[number] = token.encode()
        self.rank, self.halves, self.age = {}, {}, {}
        for place, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b = (ids[bytes(signs[c] for c in x)] for x in (left, right))
            whole = ids[self.bytes_of[a] + self.bytes_of[b]]
            self.rank[a, b] = place
            # a token reached by several merges is built by the first of them
            if whole not in self.halves:
                self.halves[whole], self.age[whole] = (a, b), place
        self.matches = ahocorasick.Automaton()
        for raw, number in ids.items():
            self.matches.add_word(raw.decode("latin-1"), (len(raw), number))
        self.matches.make_automaton()
        self.fit = Latest(self.fits)
        self.split_special = (re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")")
                              if self.special else None)

    def fits(self, pair: tuple[int, int]) -> bool:
        """Whether encoding a's bytes followed by b's gives a, b.

        The merges that made a and b are taken back, the latest first. A merge across the border must not have been due
        before the merge just taken back; merges of equal rank go from left to right.
        """
        age, rank, (a, b) = self.age, self.rank, pair
        due = len(rank) + 1
        while True:
            across = rank.get((a, b))
            if across is not None and across < due:
                return False
            of_a, of_b = age.get(a, -1), age.get(b, -1)
            if of_a > of_b:
                due, a = of_a, self.halves[a][1]
            elif of_b >= 0:
                due, b = of_b + 1, self.halves[b][0]
            else:
                return True

    def piece(self, raw: str) -> list[int]:
        """Ids of one piece, given as its UTF-8 bytes in Latin-1."""
        last, fit = [0] * (len(raw) + 1), self.fit
        done = 0
        # matches come by their end, the longest first
        for end, (size, token) in self.matches.iter(raw):
            if end < done:
                continue
            start = end + 1 - size
            if start and not fit[last[start], token]:
                continue
            last[end + 1] = token
            done = end + 1
        ids, at = [], len(raw)
        while at:
            ids.append(last[at])
            at -= len(self.bytes_of[last[at]])
        ids.reverse()
        return ids

    def decode(self, ids) -> bytes:
        """UTF-8 of the decoded text; bytes that are no text become replacement signs."""
        return b"".join([self.bytes_of[i] for i in ids]).decode("utf-8", "replace").encode()

    def ids(self, text: str) -> list[int]:
        """Ids of a whole text."""
        return [i for part in self.table(tuple).parts(text) for i in part]

    def table(self, value: Callable) -> "Pieces":
        return Pieces(self, value)


class Pieces(Latest):
    """piece -> value(ids), for the pieces of texts as ``parts`` gives them."""

    pattern = PIECES
    wide, narrow = staticmethod(regex.compile(PIECES).findall), staticmethod(re.compile(NARROW).findall)

    def __init__(self, encoder: Encoder, value: Callable):
        super().__init__(lambda piece: value(encoder.piece(piece.encode("utf-8", "surrogatepass").decode("latin-1"))))
        self.encoder, self.value = encoder, value

    def split(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.wide(text)
        return self.narrow(text)

    def parts(self, text: str) -> list:
        """Values of the pieces of a text, in order."""
        if self.encoder.split_special is None:
            return [self[p] for p in self.split(text)]
        parts = []
        for k, stretch in enumerate(self.encoder.split_special.split(text)):
            if k % 2:
                parts.append(self.value([self.encoder.special[stretch]]))
            elif stretch:
                parts += [self[p] for p in self.split(stretch)]
        return parts


@functools.lru_cache(maxsize=4)
def encoder_of(path: str) -> Encoder:
    """The worker's encoder of a vocabulary file; Python workers serve many tasks."""
    return Encoder(path)


@functools.lru_cache(maxsize=2)
def _coded(path: str) -> Pieces:
    encoder = encoder_of(path)
    return encoder.table(lambda ids: (len(ids), ",".join(map(str, ids)), b"".join([encoder.bytes_of[i] for i in ids])))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(docs: DataFrame, id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """Ids and decoded text of every row: ``id``, ``ids`` (array of int) and ``decoded``."""
    small_batches(docs.sparkSession)
    path = path or default_vocabulary()

    def run(batches):
        encoder = encoder_of(path)
        table = encoder.table(tuple)
        for batch in batches:
            ids = [[i for part in table.parts(t or "") for i in part] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.list_(pa.int32())),
                 pa.array([encoder.decode(i).decode() for i in ids], pa.string())], ["doc_id", "ids", "decoded"])

    return (docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
            .mapInArrow(run, "doc_id long, ids array<int>, decoded string"))


def encode_digests(docs: DataFrame, id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """Per row: the number of tokens, and SHA-256 of the ids (decimal, joined by commas) and of the decoded text.

    One pass without a shuffle. Empty and null texts have no token and the hash of the empty string.
    """
    small_batches(docs.sparkSession)
    path = path or default_vocabulary()

    def run(batches):
        table = _coded(path)
        for batch in batches:
            counts, codes, decoded = [], [], []
            for value in batch.column(1):
                parts = table.parts(value.as_py() or "")
                counts.append(sum([p[0] for p in parts]))
                codes.append(hashlib.sha256(",".join([p[1] for p in parts]).encode()).hexdigest())
                whole = b"".join([p[2] for p in parts]).decode("utf-8", "replace")
                decoded.append(hashlib.sha256(whole.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(codes), pa.array(decoded)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return (docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
            .mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"))
