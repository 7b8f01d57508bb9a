"""Byte-pair encoding and decoding with a contiguous array of part boundaries and adjacent ranks for each word."""

from __future__ import annotations

import heapq
import json
from functools import lru_cache
from hashlib import sha256

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

#: Fixed value: the pattern that splits text into words before the merges of byte-level BPE vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: ``\s`` as Unicode's White_Space; Python's own also takes U+001C..U+001F.
PATTERN = PATTERN.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s+(?!\S)", r"\p{White_Space}+(?!\P{White_Space})").replace(r"\s+", r"\p{White_Space}+")
NO_RANK = 1 << 60
#: Words of more bytes use a heap; the scan for the minimum is quadratic in the length.
LONG_WORD = 256
#: Words remembered by a Python worker.
CACHE_WORDS = 300_000


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabulary files."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Encoder:
    """Encodes and decodes as the vocabulary file's own library does without adding special tokens."""

    def __init__(self, path: str) -> None:
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or spec.get("normalizer") or pre.get("add_prefix_space"):
            raise ValueError("only byte-level BPE without normalizer or added prefix space")
        of_symbol = {s: b for b, s in byte_symbols().items()}
        as_bytes = lambda token: bytes(of_symbol[c] for c in token)
        vocab = {as_bytes(t): i for t, i in model["vocab"].items()}
        self.byte_id = [vocab.get(bytes([b])) for b in range(256)]
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = (as_bytes(t) for t in (merge.split(" ") if isinstance(merge, str) else merge))
            self.pairs.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.bytes_of = {i: t for t, i in vocab.items()}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of |= {i: s.encode() for s, i in self.added.items()}
        self.text_of = {i: str(i) for i in self.bytes_of}
        self.words = regex.compile(PATTERN).findall
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")").split if self.added else None
        self.cache: dict[str, tuple[int, ...]] = {}

    def merge(self, word: bytes) -> tuple[int, ...]:
        """Ids of one word: parts lie contiguously, each with the rank of its merge with the next part."""
        pairs, parts = self.pairs, [self.byte_id[b] for b in word]
        if len(parts) > LONG_WORD:
            return self.merge_long(parts)
        ranks = [pairs.get(p, (NO_RANK,))[0] for p in zip(parts, parts[1:])]
        while ranks:
            low = min(ranks)
            if low == NO_RANK:
                break
            i = ranks.index(low)
            parts[i] = pairs[parts[i], parts[i + 1]][1]
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = pairs.get((parts[i], parts[i + 1]), (NO_RANK,))[0]
            if i:
                ranks[i - 1] = pairs.get((parts[i - 1], parts[i]), (NO_RANK,))[0]
        return tuple(parts)

    def merge_long(self, parts: list[int]) -> tuple[int, ...]:
        """The same merges in n log n: a heap of (rank, place) over a linked list."""
        pairs, n = self.pairs, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(pairs[p][0], i, *p) for i, p in enumerate(zip(parts, parts[1:])) if p in pairs]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j >= n or parts[i] != a or parts[j] != b:
                continue
            parts[i], parts[j] = pairs[a, b][1], -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (p := (parts[x], parts[y])) in pairs:
                    heapq.heappush(heap, (pairs[p][0], x, *p))
        return tuple(p for p in parts if p >= 0)

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        cache, put = self.cache, ids.extend
        for piece in self.split_added(text) if self.split_added else (text,):
            if piece in self.added:
                ids.append(self.added[piece])
                continue
            for word in self.words(piece):
                try:
                    put(cache[word])
                except KeyError:
                    found = self.merge(word.encode())
                    if len(word) < 64:
                        if len(cache) >= CACHE_WORDS:
                            cache.clear()
                        cache[word] = found
                    put(found)
        return ids

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        """Bytes that are no UTF-8 (ids cut inside a character) become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_digests(df: DataFrame, *, path: str | None = None, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """``key, n_tokens, ids_sha256, decoded_sha256`` for every row, and ``token_ids`` if asked for.

    A null or empty text gives no token. Texts are encoded whole, one at a time; other columns are not read. The
    plan is a scan and one Arrow map without shuffle.
    """
    import pyarrow as pa

    schema = StructType([StructField(key, df.schema[key].dataType), StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())])
    if with_ids:
        schema = schema.add("token_ids", ArrayType(IntegerType()))

    def run(batches):
        enc = encoder(path or vocabulary_path())
        for batch in batches:
            counts, ids_sha, text_sha, kept = [], [], [], []
            for value in batch.column(1):
                ids = enc.encode(value.as_py() or "")
                counts.append(len(ids))
                ids_sha.append(sha256(",".join(map(enc.text_of.__getitem__, ids)).encode()).hexdigest())
                text_sha.append(sha256(enc.decode(ids).encode()).hexdigest())
                if with_ids:
                    kept.append(np.array(ids, np.int32))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            if with_ids:
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*kept, np.empty(0, np.int32)]))))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return df.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(run, schema)


def encode_documents(df: DataFrame, *, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, token_ids array<int>`` for every row."""
    return encode_digests(df, path=path, key=key, text=text, with_ids=True).select(key, "token_ids")


def decode_documents(df: DataFrame, *, path: str | None = None, key: str = "doc_id", ids: str = "token_ids") -> DataFrame:
    """``key, text`` from a column of id lists (null: null)."""
    import pyarrow as pa

    schema = StructType([StructField(key, df.schema[key].dataType), StructField("text", StringType())])

    def run(batches):
        enc = encoder(path or vocabulary_path())
        for batch in batches:
            texts = [None if v.as_py() is None else enc.decode(v.as_py()) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=schema.names)

    return df.select(F.col(key).alias("_key"), F.col(ids).alias("_ids")).mapInArrow(run, schema)
