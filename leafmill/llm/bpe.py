"""Byte-level BPE: a global shuffle of distinct words, each encoded once; decoding joins the token-byte table."""

from __future__ import annotations

import base64
import struct
import uuid
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.llm.scratch import give_back, partitions, shared_dir

BLOCK_CHARS = 8_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks from a rank file; the file is a vocabulary of fixed size."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def _pack(*arrays) -> bytes:
    """One compressed payload of byte strings."""
    import zstandard

    raw = [x if isinstance(x, bytes) else np.ascontiguousarray(x).tobytes() for x in arrays]
    return zstandard.ZstdCompressor(level=3).compress(struct.pack(f"<{len(raw) + 1}Q", len(raw), *map(len, raw)) + b"".join(raw))


def _unpack(payload: bytes) -> list[bytes]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(payload)
    (n,) = struct.unpack_from("<Q", raw)
    out, at = [], 8 * (n + 1)
    for size in struct.unpack_from(f"<{n}Q", raw, 8):
        out.append(raw[at : at + size])
        at += size
    return out


def _planes(codes: np.ndarray) -> list[bytes]:
    """The four bytes of each code, one string for each place, which compresses better."""
    return [x.tobytes() for x in codes.astype("<u4").view(np.uint8).reshape(-1, 4).T]


def _codes(planes: list[bytes]) -> np.ndarray:
    return np.ascontiguousarray(np.stack([np.frombuffer(x, np.uint8) for x in planes], 1)).view("<u4").reshape(-1)


class _Block:
    """Documents whose distinct words are numbered together. A word's code is parts * place + part."""

    def __init__(self):
        self.words: dict[str, int] = defaultdict()
        self.words.default_factory = self.words.__len__
        self.ids: list = []
        self.tokens: list[np.ndarray] = []
        self.chars = 0

    def add(self, doc_id, text: str | None, find) -> None:
        found = find(text or "")
        self.ids.append(doc_id)
        self.tokens.append(np.fromiter(map(self.words.__getitem__, found), np.uint32, len(found)))
        self.chars += len(text or "")  # bounds the block

    def rows(self, block: int, parts: int) -> pd.DataFrame:
        seq = np.concatenate(self.tokens)
        words = [w.encode("utf-8") for w in self.words]
        part = np.fromiter((zlib.crc32(w) % parts for w in words), np.int64, len(words))
        order = np.lexsort((-np.bincount(seq, minlength=len(words)), part))
        starts = np.searchsorted(part[order], np.arange(parts + 1))
        code = np.empty(len(words), np.int64)
        code[order] = (np.arange(len(words)) - starts[part[order]]) * parts + part[order]
        out = [(block, "docs", -1, self.ids, _pack(np.array(list(map(len, self.tokens)), "<u4"), *_planes(code[seq])))]
        for p in np.unique(part):
            mine = [words[k] for k in order[starts[p] : starts[p + 1]]]
            out.append((block, "words", int(p), None, _pack(np.array(list(map(len, mine)), "<u4"), b"".join(mine))))
        return pd.DataFrame(out, columns=["block", "kind", "part", "doc_ids", "payload"])


def _cut(lens: np.ndarray, blob: bytes) -> list[bytes]:
    ends = np.cumsum(lens, dtype=np.int64)
    return [blob[a:b] for a, b in zip((ends - lens).tolist(), ends.tolist())]


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, ids): token ids of each text as little-endian unsigned 32-bit integers, without special tokens.

    A text is cut by the pattern and each match is encoded by itself. Pre-tokens with their positions are kept by
    blocks of documents, as codes of the block's distinct words; the words go by hash to parts, where each distinct
    one is encoded once; their ids go back to the blocks, which put the documents together by position. A block
    holds about block_chars characters, and a document is never split. The blocks are a table bucketed by block in
    the shared folder, so they aren't shuffled again. A null or empty text has no ids. Ids may be null or repeated;
    each row gives one row.
    """
    spark = docs.sparkSession
    parts = parts or 2 * partitions(spark)
    ranks = spark.sparkContext.broadcast(read_ranks(ranks_path))
    wide = max(ranks.value.values()) >= 65536
    id_type = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import regex
        from pyspark import TaskContext

        find = regex.compile(pattern).findall
        number, block = TaskContext.get().partitionId() << 32, _Block()
        for pdf in batches:
            for doc_id, text in zip(pdf["doc_id"].tolist(), pdf["text"].tolist()):
                block.add(None if pd.isna(doc_id) else doc_id, text, find)
                if block.chars >= block_chars:
                    yield block.rows(number, parts)
                    number, block = number + 1, _Block()
        if block.ids:
            yield block.rows(number, parts)
        del block
        give_back()

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        import tiktoken

        piece = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks.value, special_tokens={})._encode_single_piece
        kind = np.dtype("<u4" if wide else "<u2")
        known: dict[bytes, bytes] = {}  # ids as bytes take far less memory than lists
        out = []
        for block, payload in zip(pdf["block"], pdf["payload"]):
            lens, blob = _unpack(payload)
            words = _cut(np.frombuffer(lens, "<u4"), blob)
            for w in words:
                if w not in known:
                    known[w] = np.array(piece(w), kind).tobytes()
            found = [known[w] for w in words]
            out.append((block, int(pdf["part"].iloc[0]), _pack(np.array(list(map(len, found)), "<u4") // kind.itemsize, b"".join(found))))
        known.clear()
        give_back()
        return pd.DataFrame(out, columns=["block", "part", "payload"])

    def join(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        sizes, flats, where = [], [], []
        for part, payload in zip(right["part"], right["payload"]):
            lens, flat = _unpack(payload)
            lens = np.frombuffer(lens, "<u4")
            sizes.append(lens)
            flats.append(np.frombuffer(flat, "<u4" if wide else "<u2"))
            where.append(np.arange(len(lens)) * parts + part)
        codes = np.concatenate(where) if where else np.empty(0, np.int64)
        lens = np.concatenate(sizes).astype(np.int64) if sizes else np.empty(0, np.int64)
        flat = np.concatenate(flats).astype("<u4") if flats else np.empty(0, "<u4")
        size, start = np.zeros(codes.max(initial=-1) + 1, np.int64), np.zeros(codes.max(initial=-1) + 1, np.int64)
        size[codes], start[codes] = lens, np.cumsum(lens) - lens
        n_tokens, *planes = _unpack(left["payload"].iloc[0])
        ends = np.cumsum(np.frombuffer(n_tokens, "<u4"), dtype=np.int64)
        seq = _codes(planes)
        del planes, flats, sizes, where, codes
        out, begin = [], 0
        for end in ends:
            mine = seq[begin:end]
            n = size[mine]
            at = np.repeat(start[mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            out.append(flat[at].tobytes())
            begin = end
        del seq, flat, size, start
        give_back()
        return pd.DataFrame({"doc_id": pd.Series(list(left["doc_ids"].iloc[0]), dtype="object"), "ids": out})

    name = f"bpe_blocks_{uuid.uuid4().hex}"
    blocks = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(
        cut, f"block long, kind string, part int, doc_ids array<{id_type}>, payload binary"
    )
    blocks.write.partitionBy("kind").bucketBy(parts, "block").option("compression", "none").option("path", f"{shared_dir(spark)}/leafmill/{name}").saveAsTable(name)
    table = spark.table(name)
    coded = table.filter("kind = 'words'").groupBy("part").applyInPandas(merge, "block long, part int, payload binary")
    kept = table.filter("kind = 'docs'").select("block", "doc_ids", "payload")
    return kept.groupBy("block").cogroup(coded.groupBy("block")).applyInPandas(join, f"doc_id {id_type}, ids binary")


def decode(encoded: DataFrame, ranks_path: str, ids_col: str = "ids", out_col: str = "bytes") -> DataFrame:
    """encoded with a column of the bytes that its ids stand for; a null list of ids gives null.

    The token-byte table has one row per rank, a fixed number, and is broadcast.
    """
    ranks = read_ranks(ranks_path)
    table = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    shared = encoded.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf(T.BinaryType())
    def of(ids: pd.Series) -> pd.Series:
        get = shared.value.__getitem__
        return pd.Series([None if x is None else b"".join(map(get, np.frombuffer(x, "<u4").tolist())) for x in ids])

    return encoded.withColumn(out_col, of(F.col(ids_col)))
