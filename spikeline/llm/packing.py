"""Best-fit packing with large-item matching.

Texts become token ids with id 1 at their end; longer ones than the capacity are
cut into full pieces and a rest. How pieces fit depends on their lengths alone, so
the plan is made on the histogram of lengths, at most `capacity` counts whatever
the corpus: pieces of over a third of the capacity pair at most twice a bin, each
with the longest that still fits (greedy matching from the longest down); then
lengths of a third or less, from the longest down, go to the bins with the least
room that holds them, or to new ones. Bins that agree are planned together, as
runs of sequences. Pieces are numbered within their length and take the places
of the plan in that order.

Numbers come from groups of about GROUP pieces by length and hash, so a length
that a third of all pieces have is numbered in parallel.

Pieces can carry their ids, so that sequences() gives what a model reads; without them
rows stay small where only the layout is asked for.

Nulls: a null text is empty and yields the end id alone. Rows that repeat a doc_id
are packed each; extra columns don't matter; no rows give no sequences.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read, utf8

CAPACITY = 4096
END = 1
GROUP = 20_000
GROUP_IDS = 4 << 20  # token ids carried by such a group, at most about
WORDS = 1_500_000  # that a Python worker remembers the ids of, some 300 MB; beyond, it starts anew


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: How PLAIN words become pieces; holds for vocabularies whose own steps are these.
STEPS = {
    "normalizers": ["NFC", "Replace", "Lowercase"],
    "split": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
}  # fixed values
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")  # signs that are composed already and have one lower-case form
LETTERS = "a-zß-öø-ÿ"
PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^0-9{LETTERS}]+")
_SEEN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}  # bytes that stand for themselves
BYTES = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _SEEN)}


def _has_steps(path: str) -> bool:
    with open(path) as f:
        config = json.load(f)
    parts = (config["normalizer"] or {}).get("normalizers", [])
    cuts = (config["pre_tokenizer"] or {}).get("pretokenizers", [])
    return (
        [x["type"] for x in parts] == STEPS["normalizers"]
        and [x["type"] for x in cuts] == ["Split", "ByteLevel"]
        and cuts[0]["pattern"] == {"Regex": STEPS["split"]}
        and not cuts[1]["add_prefix_space"]
        and not cuts[1]["use_regex"]
    )


class WordIds(dict):
    """Words to their ids, as bytes of little-endian unsigned 32-bit numbers.

    The vocabulary's pre-tokenizer never joins what white space parts, so a text's
    ids are those of its words, one after another. PLAIN words are cut into pieces
    here, and pieces' ids kept as well; others go through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.plain = _has_steps(path)
        self.pieces: dict[str, bytes] = {}

    def piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            signs = piece if piece.isascii() else piece.encode().decode("latin-1").translate(BYTES)
            found = [x.id for x in self.model.tokenize(signs)]
            ids = self.pieces[piece] = struct.pack(f"<{len(found)}I", *found)
        return ids

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= WORDS:
            self.clear()
            self.pieces.clear()
        text = word.decode()
        if self.plain and PLAIN.fullmatch(text) and "<|" not in text:  # which begins special tokens
            ids = b"".join(map(self.piece, PIECES.findall(text.lower())))
        else:
            found = self.tokenizer.encode([text], is_pretokenized=True, add_special_tokens=False).ids
            ids = struct.pack(f"<{len(found)}I", *found)
        self[word] = ids
        return ids

    def ids(self, text: bytes) -> bytes:
        return b"".join(map(self.__getitem__, text.split())) + struct.pack("<I", END)


_KNOWN: dict[str, WordIds] = {}  # by vocabulary


def known_words(path: str) -> WordIds:
    """One for each worker: found by name there, not sent along with each task."""
    if path not in _KNOWN:
        _KNOWN[path] = WordIds(path)
    return _KNOWN[path]


PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece of every text, and the token ids themselves if `ids`."""
    path = path or tokenizer_path()
    schema = PIECE + ", ids array<int>" * ids
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = known_words(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                doc_ids, texts = (c.to_pylist() for c in batch.slice(at, 256).columns)
                out = []
                for doc_id, data in zip(doc_ids, map(words.ids, texts)):
                    for k in range(0, len(data), 4 * capacity):
                        part = data[k : k + 4 * capacity]
                        row = (doc_id, k // (4 * capacity), k // 4, len(part) // 4, zlib.crc32(part))
                        out.append((*row, np.frombuffer(part, "<i4")) if ids else row)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text")).mapInArrow(cut, schema)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[dict[int, list[tuple[int, int, int, int]]], int]:
    """Where pieces of each length go: runs (first number, first sequence, pieces a
    sequence, offset); and how many sequences there are."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {n: [] for n in counts}
    left = {n: c for n, c in counts.items() if c}
    taken = dict.fromkeys(counts, 0)
    room: dict[int, list[tuple[int, int]]] = {}  # by what is left in a bin: runs of bins (first, how many)
    rooms: list[int] = []
    bins = 0

    def place(n: int, many: int, first: int, each: int, offset: int) -> None:
        runs[n].append((taken[n], first, each, offset))
        taken[n] += many

    def leave(size: int, first: int, many: int) -> None:
        if many:
            if size not in room:
                room[size] = []
                insort(rooms, size)
            room[size].append((first, many))

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        n = large[-1]
        partner = next((x for x in reversed(large) if x <= capacity - n and (x != n or left[n] > 1)), None)
        if partner is None:
            many = left[n]
        elif partner == n:
            many = left[n] // 2
        else:
            many = min(left[n], left[partner])
        if partner == n:
            place(n, 2 * many, bins, 2, 0)
        else:
            place(n, many, bins, 1, 0)
            if partner:
                place(partner, many, bins, 1, n)
        for x in (n, partner) if partner else (n,):
            left[x] -= many
        leave(capacity - n - (partner or 0), bins, many)
        bins += many
        large = [x for x in large if left[x]]
    for n in sorted((x for x in left if 3 * x <= capacity), reverse=True):
        todo = left[n]
        while todo:
            at = bisect_left(rooms, n)
            if at == len(rooms):
                many = -(-todo // (capacity // n))
                leave(capacity, bins, many)
                bins += many
                continue
            size = rooms[at]
            first, many = room[size].pop()
            if not room[size]:
                del room[size]
                rooms.pop(at)
            each = min(size // n, todo)
            used = min(many, todo // each)
            leave(size, first + used, many - used)
            place(n, used * each, first, each, capacity - size)
            leave(size - each * n, first, used)
            todo -= used * each
    return runs, bins


def _placed(runs: dict[int, list[tuple[int, int, int, int]]]):
    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {n: np.array(x, np.int64).T for n, x in runs.items()}
        for batch in batches:
            length = batch.column("length").to_numpy()
            number = batch.column("number").to_numpy()
            sequence, offset = np.empty(length.size, np.int64), np.empty(length.size, np.int64)
            order = np.argsort(length, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if order.size else ():
                n = int(length[part[0]])
                begin, first, each, at = tables[n]
                k = np.searchsorted(begin, number[part], "right") - 1
                q, r = np.divmod(number[part] - begin[k], each[k])
                sequence[part], offset[part] = first[k] + q, at[k] + r * n
            out = batch.drop_columns(["number"])
            yield out.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    return placed


def pack(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """rows: of pieces(). Adds sequence_id and offset. The driver sees one count a length."""
    rows = materialize(rows, "pieces")
    counts = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}
    runs, _ = plan(counts, capacity)
    names, told = rows.columns, [x.split()[0] for x in PIECE.split(", ")]
    most = {n: min(GROUP, max(1, GROUP_IDS // n)) if "ids" in names else GROUP for n in counts}
    cut = {n: -(-c // most[n]) for n, c in counts.items() if c > most[n]}
    salts = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in cut.items() for x in pair]), "length"), F.lit(1)) if cut else F.lit(1)
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(*told), salts).cast("int"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = salted.groupBy("length", "salt").count().select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "salt").orderBy(*[x for x in told if x != "length"]))
    numbered = salted.join(starts, ["length", "salt"]).withColumn("number", F.col("before") + inside - 1)
    return numbered.select(*names, "number").mapInArrow(_placed(runs), ", ".join([PIECE, *["ids array<int>"] * ("ids" in names), "sequence_id long, offset long"]))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    return pack(pieces(docs, capacity, ids=ids), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, doc_ids and starts (offsets of the pieces) and ids, of pack_documents(ids=True): a row for each sequence, `capacity` ids at most."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))
    rows = packed.groupBy("sequence_id").agg(parts.alias("parts"))
    return rows.select("sequence_id", F.col("parts.doc_id").alias("doc_ids"), F.col("parts.offset").alias("starts"), F.flatten("parts.ids").alias("ids"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens."""
    return pack_documents(read(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op10_packing": op10_packing}
ORACLE: dict[str, str] = {}
