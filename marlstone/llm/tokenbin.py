"""Token ids as binary shards with a minimal perfect hash index.

Documents are dealt by ranges of their ids, so the shards in order hold all documents in ascending id. One file is

    magic | ids, each document's followed by the end id | row table | index | description (JSON) | its size

Ids are raw little-endian unsigned integers of the least width that holds the vocabulary, 16 or 32 bits.
The row table has the key, a null flag and the first id's place of every document. The index maps a key by a minimal
perfect hash to a slot with a 32-bit fingerprint and the first row of that key: keyed access in constant time
(``Shard.rows``). Files are written under a name of the attempt's own and then renamed, so a task that is run again
replaces its file by the same one.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .perfecthash import PerfectHash, fingerprints, mix

MAGIC = b"MARLSHD1"
END_ID = 0
#: Characters that are tokenized together, and units that a worker keeps.
BLOCK_CHARS, MEMO_UNITS, MEMO_LENGTH = 1 << 20, 1_200_000, 64
#: Letters of the Latin blocks, each of which the splitting pattern takes for a letter.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
_NULL_KEY = np.uint64(0xA5A5A5A55A5A5A5A)
_CODERS: dict[str, Coder] = {}


class Coder:
    """The tokenizers library's encoding, with a memo of the units between which its splitting pattern always cuts.

    A byte-level BPE's pattern never lets a piece cross from a run of other characters to white space, save one
    blank before the run, nor from Latin letters to ASCII digits and marks or back, save at an apostrophe. So the ids
    of a text are those of its units in turn, and each different unit is encoded once. Texts in which the library's
    idea of white space or special tokens could cut elsewhere go to it whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.memo: dict[str, bytes] = {}
        self.dtype = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        letters, marks = rf" ?[{_LETTERS}]++(?=[\x00-\x7f]|\Z)", rf" ?[!-&(-@\[-`{{-~]++(?=[{_LETTERS}\s]|\Z)"
        self.units = re.compile(rf"{letters}|{marks}| ?\S+|\s+(?!\S)|\s+")
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = re.compile("|".join(["[\x1c-\x1f]", *map(re.escape, special)]))
        split = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.split = split[0] if len(split) == 1 and self._by_pattern() else None

    def _by_pattern(self) -> bool:
        kind = json.loads(self.tokenizer.to_str())
        pre = kind["pre_tokenizer"] or {}
        return kind["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") is True and not pre.get("add_prefix_space")

    def _direct(self, text: str) -> bytes:
        return self._ids(text).tobytes()

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)

    def _learn(self, units: list[str]) -> None:
        """Encode new units, joined by a line break, whose id no unit has."""
        plain = [u for u in units if not u.isspace() and len(u) <= MEMO_LENGTH]
        for u in units:
            if u.isspace():
                self.memo[u] = self._direct(u)
        for lo in range(0, len(plain), 20_000):
            some = plain[lo : lo + 20_000]
            ids = self._ids("\n".join(some))
            cuts = np.flatnonzero(ids == self.split)
            if len(cuts) != len(some) - 1:  # a piece crosses a line break: unit by unit
                self.memo.update((u, self._direct(u)) for u in some)
                continue
            raw = ids.tobytes()
            begins, ends = [0, *((cuts + 1) * ids.itemsize).tolist()], [*(cuts * ids.itemsize).tolist(), len(raw)]
            self.memo.update((u, raw[a:b]) for u, a, b in zip(some, begins, ends, strict=True))

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        """Of each text, the ids as raw integers of this coder's dtype."""
        texts = list(texts)
        if self.split is None:
            return [self._direct(t) for t in texts]
        parts = [None if self.whole.search(t) else self.units.findall(t) for t in texts]
        new = {u for p in parts if p for u in p}.difference(self.memo)
        if len(self.memo) + len(new) > MEMO_UNITS:
            self.memo.clear()
            new = {u for p in parts if p for u in p}
        self._learn(list(new))
        memo, direct = self.memo, self._direct
        out = []
        for text, part in zip(texts, parts, strict=True):
            if part is None:
                out.append(direct(text))
            else:
                try:
                    out.append(b"".join([memo[u] for u in part]))
                except KeyError:  # a unit that is too long to keep
                    out.append(b"".join([memo[u] if u in memo else direct(u) for u in part]))
        return out


def coder(path: str) -> Coder:
    """One for each worker process, with its memo."""
    if path not in _CODERS:
        _CODERS[path] = Coder(path)
    return _CODERS[path]


def _hashed(keys: np.ndarray, nulls: np.ndarray) -> np.ndarray:
    """Keys of the index: ids spread over 64 bits, a key of its own for null."""
    return np.where(nulls, _NULL_KEY, mix(keys.view(np.uint64), 3))


class ShardWriter:
    """Writes one file; documents must come in the order of their keys, equal keys together."""

    def __init__(self, folder: str, name: str, dtype: str):
        self.dtype = np.dtype(dtype)
        self.fs, self.folder = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.folder, recursive=True)
        self.name, self.attempt = f"{self.folder}/{name}.ids", f"{self.folder}/.{name}-{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.attempt)
        self.out.write(MAGIC)
        self.keys: list[int] = []
        self.nulls: list[bool] = []
        self.sizes: list[int] = []

    def add(self, key: int | None, ids: bytes) -> None:
        self.out.write(ids)
        self.keys.append(0 if key is None else key)
        self.nulls.append(key is None)
        self.sizes.append(len(ids) // self.dtype.itemsize)

    def close(self) -> dict:
        keys, nulls = np.array(self.keys, np.int64), np.array(self.nulls, bool)
        begins = np.concatenate([[0], np.cumsum(np.array(self.sizes, np.int64))])
        hashed, first = np.unique(_hashed(keys, nulls), return_index=True)
        index = PerfectHash.build(hashed)
        slots = index.slots(hashed)
        prints, rows = np.zeros(len(hashed), np.uint32), np.zeros(len(hashed), np.uint32)
        prints[slots], rows[slots] = fingerprints(hashed), first
        parts = {"keys": keys, "nulls": nulls, "begins": begins, "level_sizes": index.sizes, "bits": np.packbits(index.bits), "prints": prints, "rows": rows}
        at, described = len(MAGIC) + self.dtype.itemsize * int(begins[-1]), {"places": len(index.bits), "dtype": self.dtype.str}
        for k, v in parts.items():
            described[k] = [at, v.dtype.str, len(v)]
            self.out.write(v.tobytes())
            at += v.nbytes
        footer = json.dumps(described).encode()
        self.out.write(footer + len(footer).to_bytes(8, "little"))
        self.out.close()
        self.fs.move(self.attempt, self.name)
        return {"docs": len(keys), "ids": int(begins[-1])}


class Shard:
    """An open file: the row table in order, and rows by key."""

    def __init__(self, folder: str, name: str):
        fs, path = pafs.FileSystem.from_uri(folder)
        self.file = fs.open_input_file(f"{path}/{name}.ids")
        size = self.file.size()
        if self.file.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"{name} isn't a shard")
        length = int.from_bytes(self.file.read_at(8, size - 8), "little")
        described = json.loads(self.file.read_at(length, size - 8 - length))
        part = {k: np.frombuffer(self.file.read_at(np.dtype(v[1]).itemsize * v[2], v[0]), v[1]) for k, v in described.items() if isinstance(v, list)}
        self.dtype = np.dtype(described["dtype"])
        self.keys, self.nulls, self.begins, self.prints, self.first = (part[k] for k in ("keys", "nulls", "begins", "prints", "rows"))
        self.index = PerfectHash(part["level_sizes"], np.unpackbits(part["bits"], count=described["places"]).astype(bool))

    def first_rows(self, hashed: np.ndarray) -> np.ndarray:
        """By the index: the first row of each hashed key, -1 where the key isn't in this shard."""
        slots = self.index.slots(hashed)
        rows = np.where(slots >= 0, self.first[slots] if len(self.first) else -1, -1).astype(np.int64)
        return np.where((slots >= 0) & (self.prints[slots] == fingerprints(hashed)), rows, -1) if len(self.first) else rows

    def rows(self, key: int | None) -> list[bytes]:
        """The ids of every document with this key."""
        hashed = _hashed(np.array([key or 0], np.int64), np.array([key is None]))
        row, found = int(self.first_rows(hashed)[0]), []
        while 0 <= row < len(self.keys) and (self.nulls[row] if key is None else not self.nulls[row] and self.keys[row] == key):
            found.append(self.payload(row, row + 1))
            row += 1
        return found

    def payload(self, lo: int, hi: int) -> bytes:
        """The ids of the rows from lo to hi as little-endian unsigned 32-bit integers."""
        wide = self.dtype.itemsize
        raw = self.file.read_at(wide * int(self.begins[hi] - self.begins[lo]), len(MAGIC) + wide * int(self.begins[lo]))
        return np.frombuffer(raw, self.dtype).astype("<u4").tobytes()


def write_shards(docs: DataFrame, folder: str, tokenizer: str, key: str = "doc_id", text: str = "text") -> list[dict]:
    """Encode every text (null: empty), append the end id, write the shards; the manifest, one entry for each shard
    in order: name, docs, ids. Repeated keys keep all their rows; null keys come first."""
    common.ship(docs.sparkSession)
    slim = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    slim = slim.withColumn("tie", F.xxhash64("text"))
    dealt = slim.repartitionByRange("key", "tie").sortWithinPartitions("key", "tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = coder(tokenizer)
        end = np.array([END_ID], own.dtype).tobytes()
        writer, first, number = None, None, TaskContext.get().partitionId()
        for batch in batches:
            keys, texts, ties = batch.column(0).to_pylist(), batch.column(1), batch.column(2)
            lengths = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64))
            lo = 0
            while lo < len(keys):
                hi = max(lo + 1, int(np.searchsorted(lengths, (lengths[lo - 1] if lo else 0) + BLOCK_CHARS)))
                for k, ids in zip(keys[lo:hi], own.encode(texts[lo:hi].to_pylist()), strict=True):
                    if writer is None:
                        writer, first = ShardWriter(folder, f"shard-{number:06d}", own.dtype), (k, ties[lo].as_py())
                    writer.add(k, ids + end)
                lo = hi
        if writer is not None:
            done = writer.close()
            yield pa.RecordBatch.from_pydict({"name": [f"shard-{number:06d}"], "key": pa.array([first[0]], pa.int64()), "tie": [first[1]], "docs": [done["docs"]], "ids": [done["ids"]]})

    rows = dealt.mapInArrow(run, "name string, key long, tie long, docs long, ids long").collect()
    rows.sort(key=lambda r: (r["key"] is not None, r["key"] or 0, r["tie"]))
    return [{"name": r["name"], "docs": r["docs"], "ids": r["ids"]} for r in rows]


def read_shards(spark: SparkSession, folder: str, manifest: list[dict]) -> DataFrame:
    """From the files: doc_id, start, n_tokens, ids_crc32 of every document; each is found by its key in the index."""
    common.ship(spark)
    base, entries = 0, []
    for entry in manifest:
        entries.append((entry["name"], base))
        base += entry["ids"]
    shards = spark.createDataFrame(entries, "name string, base long")
    if entries:
        shards = shards.repartition(len(entries), "name")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, begin in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = Shard(folder, name)
                rows = np.arange(len(shard.keys))
                first = shard.first_rows(_hashed(shard.keys, shard.nulls))
                same = (shard.keys[first] == shard.keys) & (shard.nulls[first] == shard.nulls)
                if (first < 0).any() or not same.all() or (first > rows).any():
                    raise ValueError(f"the index of {name} doesn't lead to its rows")
                for lo in range(0, len(rows), 1024):
                    hi = min(lo + 1024, len(rows))
                    ids, cuts = memoryview(shard.payload(lo, hi)), 4 * (shard.begins[lo : hi + 1] - shard.begins[lo])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(shard.keys[lo:hi], pa.int64(), mask=shard.nulls[lo:hi]),
                            pa.array(begin + shard.begins[lo:hi]),
                            pa.array(np.diff(shard.begins[lo : hi + 1])),
                            pa.array([zlib.crc32(ids[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], pa.int64()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return shards.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenizer_path() -> str:
    """Where the default vocabulary lies; a parameter everywhere else."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_documents(docs: DataFrame, tokenizer: str | None = None, folder: str | None = None) -> DataFrame:
    """Write docs (doc_id, text) as token shards in the shared folder and describe every document from them.

    A null text is empty: its only id is the end id. Null ids come before all others and repeated ids keep all their
    rows, in the order of their texts' hashes. An empty table writes nothing and gives an empty result. Other columns
    are not read. Very long texts are encoded whole.
    """
    spark = docs.sparkSession
    folder = folder or common.new_path(spark, "token-shards")
    manifest = write_shards(docs, folder, tokenizer or tokenizer_path())
    return read_shards(spark, folder, manifest)


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(common.table(spark, sf_dir, "documents"))
