"""Token ids in length-delimited binary files, with an index of offsets for shuffled reads.

A record is framed as: 8-byte length of the payload, 4-byte masked checksum of that length, payload, 4-byte masked
checksum of the payload; numbers are little-endian. The payload is a 1-byte flag (1: the document has an id, 2: ids have
4 bytes), the 8-byte document id and the token ids, 2 bytes each where the vocabulary allows, else 4. The checksum is zlib's CRC-32 c, masked as (c rotated right by 15 bits +
0xa282ead8) mod 2**32, so that checksums stored inside checksummed data do not cancel. Beside ``part-N.ids`` stands
``part-N.idx``: for each record its byte offset and the number of ids before it in the file (two 8-byte numbers).
"""

from __future__ import annotations

import json
import os
import posixpath
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as filesystems
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazewell.llm.words import pieces

END_ID = 2
CACHE_PIECES = 1_600_000
#: Files that a task of a shuffled read keeps open.
OPEN_FILES = 64
#: Signs that the tokenizer's pattern takes together wherever they follow a word (an apostrophe may begin a suffix).
SIGNS = '.,;:!?$%&#*()[]{}<>|"-_/\\+=@^~`'
class ByteSigns(dict):
    """The byte-level alphabet: a character's UTF-8 bytes, where printable Latin-1 stands for itself and each other byte for
    the next code point from 256 on. Filled as characters come."""

    OTHER = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]

    def __missing__(self, character: str) -> str:
        found = self[character] = "".join(chr(256 + self.OTHER.index(b) if b in self.OTHER else b) for b in character.encode())
        return found


BYTE_SIGNS = ByteSigns()
HEAD, INDEX, BODY = "<QI", "<QQ", "<Bq"


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload))))


def read_frame(data, at: int) -> tuple[memoryview, int]:
    """The payload of the record at an offset and the offset of the next; raises ValueError for damaged or cut records."""
    if at + struct.calcsize(HEAD) > len(data):
        raise ValueError(f"record cut short at {at}")
    size, check = struct.unpack_from(HEAD, data, at)
    begin, end = at + struct.calcsize(HEAD), at + struct.calcsize(HEAD) + size
    if masked(bytes(data[at : at + 8])) != check or end + 4 > len(data):
        raise ValueError(f"damaged length at {at}")
    payload = memoryview(data)[begin:end]
    if masked(payload) != struct.unpack_from("<I", data, end)[0]:
        raise ValueError(f"damaged record at {at}")
    return payload, end + 4


class Encoder:
    """Whole texts to ids by the tokenizer file, working each distinct piece off once while it is remembered.

    The tokenizer never joins a character with a single space after it, so a text may be cut before each space that
    stands between two other characters, and the ids of the pieces are those of the text. Longer white space around a
    space stays in one piece; texts with a special token's name are encoded as one. Remembered pieces are kept in two
    generations, so that frequent ones outlast rare ones.
    """

    def __init__(self, path: str, most: int = CACHE_PIECES, kind: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self._model(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.most, self.fresh, self.old, self.units = most // 2, {}, {}, {}
        self.kind = kind or ("H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I")
        sample = ["a,", " b\na's", " c  d", " 1"]
        cut = [i for p in sample for i in self.tokenizer.encode(p, add_special_tokens=False).ids]
        self.cuts = self.tokenizer.encode("".join(sample), add_special_tokens=False).ids == cut  # else it is of another kind: no pieces
        words = ["Über,\nstraße...", "##", "plain", "a\n-\nb!?"]
        self.direct = self.cuts and [self._learn(w) for w in words] == self._ids([f" {w}" for w in words])

    def _model(self, path: str):
        """The tokenizer's pair merges without its own memory of words, whose lock costs more than it saves here."""
        from tokenizers.models import BPE

        with open(path, encoding="utf-8") as f:
            parts = json.load(f)["model"]
        if parts.pop("type", None) != "BPE":
            return self.tokenizer.model
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in parts.pop("merges")]
        known = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")
        return BPE(vocab=parts["vocab"], merges=merges, cache_capacity=0, **{k: parts[k] for k in known if parts.get(k) is not None})

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array(self.kind, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _unit(self, text: str) -> bytes:
        """Ids of a text that the tokenizer's pattern keeps whole: a word with the space before it, or a run of signs."""
        if (found := self.units.get(text)) is None:
            if len(self.units) >= self.most:
                self.units.clear()
            found = self.units[text] = array(self.kind, [t.id for t in self.model.tokenize("".join(map(BYTE_SIGNS.__getitem__, text)))]).tobytes()
        return found

    def _word(self, lead: str, word: str) -> bytes | None:
        stem = word.rstrip(SIGNS)
        if not word or (stem and not (stem.isalpha() and (stem.isascii() or max(stem) < "\u0530"))):
            return None
        if not stem or len(stem) == len(word):
            return self._unit(lead + word)
        return self._unit(lead + stem) + self._unit(word[len(stem) :])

    def _learn(self, piece: str) -> bytes | None:
        """Ids of a space and a piece of plain words with signs after them, line feeds between; None for any other piece."""
        if "\n" not in piece:
            return self._word(" ", piece)
        lines = piece.split("\n")
        out = [self._word("" if i else " ", x) for i, x in enumerate(lines)]
        return None if None in out else self._unit("\n").join(out)

    def _merged(self, parts: list[str]) -> bytes:
        """Ids of a text that has longer white space around some of its spaces: it is cut only at the others."""
        out = parts[:1]
        for p in parts[1:]:
            if p and out[-1] and not p[0].isspace() and not out[-1][-1].isspace():
                out.append(p)
            else:
                out[-1] = f"{out[-1]} {p}"
        return b"".join(self._ids([out[0], *(f" {p}" for p in out[1:])]))

    def _text(self, text: str) -> bytes:
        parts = text.split(" ")
        if not self.cuts or any(s in text for s in self.special):
            return self._ids([text])[0]
        if len(parts) > 1 and parts[0] and parts[0][-1].isspace():
            return self._merged(parts)
        known = self.fresh
        got = list(map(known.get, parts))
        got[0] = self._ids([parts[0]])[0] if parts[0] else b""
        try:
            return b"".join(got)
        except TypeError:  # some piece is not known yet
            pass
        for i in [i for i, ids in enumerate(got) if ids is None]:
            p = parts[i]
            if (ids := known.get(p)) is None and (ids := self.old.get(p)) is None:
                if not p or p[0].isspace() or p[-1].isspace():
                    return self._merged(parts)
                ids = self._learn(p) if self.direct else None
                ids = self._ids([f" {p}"])[0] if ids is None else ids
            got[i] = known[p] = ids
        if len(known) > self.most:
            self.fresh, self.old = {}, known
        return b"".join(got)

    def encode(self, texts: list[str]) -> list[bytes]:
        return list(map(self._text, texts))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def open_path(path: str):
    """File system and path in it, for a URI or a plain path."""
    return filesystems.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}")


def _put(store, path: str, parts: Iterator[bytes]) -> int:
    """Write a file under a name of its own and move it into place, so that a task run twice leaves one whole file."""
    own, n = f"{path}.{uuid.uuid4().hex}", 0
    with store.open_output_stream(own) as out:
        for part in parts:
            out.write(part)
            n += len(part)
    store.move(own, path)
    return n


def write(docs: DataFrame, folder: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID, files: int | None = None) -> DataFrame:
    """Write every document's ids, with ``end_id`` after them, in ascending doc_id order; one row (file, first id, n_records, n_tokens) per file.

    Documents are dealt over files by ranges of the id and ordered in each; a null id comes first, as Spark sorts it,
    and equal ids are ordered by text. A null or empty text is the end id alone. An empty table writes no file.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    files = files or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "text")

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        end, width, wide = array(coder.kind, [end_id]).tobytes(), array(coder.kind).itemsize, 2 * (coder.kind == "I")
        index: list[bytes] = []
        count = [0, 0]

        def records() -> Iterator[bytes]:
            at = 0
            for whole in batches:
                for batch in pieces(whole, "text", 1 << 20):
                    for i, ids in zip(batch.column(0).to_pylist(), coder.encode(batch.column(1).to_pylist())):
                        index.append(struct.pack(INDEX, at, count[1]))
                        count[0] += 1
                        count[1] += len(ids) // width + 1
                        record = frame(b"".join((struct.pack(BODY, (i is not None) + wide, i or 0), ids, end)))
                        at += len(record)
                        yield record

        name = f"part-{TaskContext.get().partitionId():06d}"
        store, at = open_path(folder)
        stream = records()
        head = next(stream, None)
        if head is None:
            return
        store.create_dir(at, recursive=True)

        def all_records() -> Iterator[bytes]:
            yield head
            yield from stream

        _put(store, posixpath.join(at, f"{name}.ids"), all_records())
        _put(store, posixpath.join(at, f"{name}.idx"), iter([b"".join(index)]))
        yield pa.RecordBatch.from_pydict({"file": [f"{folder.rstrip('/')}/{name}.ids"], "n_records": [count[0]], "n_tokens": [count[1]]}, schema=pa.schema([("file", pa.string()), ("n_records", pa.int64()), ("n_tokens", pa.int64())]))

    return rows.mapInArrow(save, "file string, n_records long, n_tokens long")


def read(spark: SparkSession, files: DataFrame, ids: bool = False, chunk: int = 8 << 20) -> DataFrame:
    """Records of the written files: file, place (its place in the file), doc_id, before (ids before it in the file), n_tokens, ids_crc32, and the ids themselves if wanted.

    Every length and payload is checked against its checksum; files are read in bounded parts. ``files`` has a column
    ``file``. The index beside each file must agree with it.
    """
    schema = "file string, place long, doc_id long, before long, n_tokens long, ids_crc32 long" + (", ids array<long>" if ids else "")

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name in batch["file"]:
                store, path = open_path(name)
                with store.open_input_stream(f"{path[:-4]}.idx") as f:
                    index = np.frombuffer(f.read(), dtype="<u8").reshape(-1, 2)
                with store.open_input_file(path) as f:
                    ends = np.append(index[1:, 0], f.size())
                    i = 0
                    while i < len(index):
                        j = max(i + 1, int(np.searchsorted(ends, index[i, 0] + np.uint64(chunk), side="right")))
                        base = int(index[i, 0])
                        data = f.read_at(int(ends[j - 1]) - base, base)
                        rows = []
                        for k in range(i, j):
                            payload, end = read_frame(data, int(index[k, 0]) - base)
                            if end + base != int(ends[k]):
                                raise ValueError(f"{name}: index and record {k} disagree")
                            flag, doc = struct.unpack_from(BODY, payload)
                            tokens = np.frombuffer(payload[struct.calcsize(BODY) :], "<u4" if flag & 2 else "<u2").astype("<u4")
                            row = (name, k, doc if flag & 1 else None, int(index[k, 1]), len(tokens), zlib.crc32(tokens.tobytes()))
                            rows.append((*row, tokens.tolist()) if ids else row)
                        out = pd.DataFrame(rows, columns=["file", "place", "doc_id", "before", "n_tokens", "ids_crc32", "ids"][: 6 + ids])
                        out["doc_id"] = out["doc_id"].astype("Int64")
                        yield out
                        i = j

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return files.select("file").repartition(parts, "file").mapInPandas(load, schema)


def read_shuffled(spark: SparkSession, files: DataFrame, seed: int = 0, parts: int | None = None) -> DataFrame:
    """Records in a random order that only ``seed`` decides: turn (a hash, ascending), file, place, doc_id, n_tokens, ids.

    The index rows of all files are dealt by ranges of their turn, and each task fetches its records by their offsets, one by
    one: no record passes through a shuffle. ``files`` has a column ``file``. Records of equal turns are ordered by file
    and place. Without files there are no rows.
    """

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name in batch["file"]:
                store, path = open_path(name)
                with store.open_input_stream(f"{path[:-4]}.idx") as f:
                    index = np.frombuffer(f.read(), dtype="<u8").reshape(-1, 2)
                with store.open_input_file(path) as f:
                    ends = np.append(index[1:, 0], np.uint64(f.size()))
                yield pd.DataFrame({"file": name, "place": np.arange(len(index)), "at": index[:, 0].astype(np.int64), "size": (ends - index[:, 0]).astype(np.int64)})

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opened: dict = {}
        for batch in batches:
            rows = []
            for turn, name, place, at, size in batch.itertuples(index=False):
                if name not in opened:
                    while len(opened) >= OPEN_FILES:
                        opened.pop(next(iter(opened))).close()
                    store, path = open_path(name)
                    opened[name] = store.open_input_file(path)
                payload, end = read_frame(opened[name].read_at(size, at), 0)
                if end != size:
                    raise ValueError(f"{name}: index and record {place} disagree")
                flag, doc = struct.unpack_from(BODY, payload)
                tokens = np.frombuffer(payload[struct.calcsize(BODY) :], "<u4" if flag & 2 else "<u2")
                rows.append((turn, name, place, doc if flag & 1 else None, len(tokens), tokens.tolist()))
            out = pd.DataFrame(rows, columns=["turn", "file", "place", "doc_id", "n_tokens", "ids"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out
        for f in opened.values():
            f.close()

    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    index = files.select("file").repartition(parts, "file").mapInPandas(entries, "file string, place long, at long, size long")
    dealt = index.select(F.xxhash64("file", "place", F.lit(seed)).alias("turn"), "file", "place", "at", "size").repartitionByRange(parts, "turn", "file", "place")
    return dealt.sortWithinPartitions("turn", "file", "place").mapInPandas(fetch, "turn long, file string, place long, doc_id long, n_tokens long, ids array<long>")


def with_starts(spark: SparkSession, files: DataFrame) -> DataFrame:
    """The records of ``read`` with ``start``, the ids of all records before them. ``files``: the stored result of ``write``.

    File names ascend with the ids, so the sum runs over one small row per file.
    """
    rows = sorted(files.collect(), key=lambda r: r["file"])  # one row a file
    starts, total = [], 0
    for r in rows:
        starts.append((r["file"], total))
        total += r["n_tokens"]
    base = F.broadcast(spark.createDataFrame(starts, "file string, base long"))
    return read(spark, files).join(base, "file").withColumn("start", F.col("base") + F.col("before")).drop("base", "before")
