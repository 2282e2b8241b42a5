"""Byte-level BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over the text's bytes cuts it into chunks, so that passages which
documents share give the same chunks wherever they stand. Every chunk that
stands in several texts is encoded once, by the task that its hash falls to, and
its ids are joined back to the texts that hold it; equal texts are encoded once
as well. A text is then put together from encoded chunks and from encodings of
what lies between them. Where two meet, the join is encoded again from the last
safe point before it to the first one after it, and reaches further out until
there is one. A safe point lies between a character that is no white space and a
space or line feed: pre-tokens never reach across it, so what is encoded from
one safe point to another agrees exactly with the encoding of the whole text.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.runtime import cut, join_unique, small_batches

#: Chunk lengths in bytes: about AVERAGE (a power of two), never outside the limits but at the end of a text.
SHORTEST, AVERAGE, LONGEST = 512, 2048, 8192
#: Bytes that the rolling hash sees, a power of two.
WINDOW = 16
#: Keys of texts are broadcast up to so many (32 bytes each); beyond it they are joined by shuffle.
BROADCAST_KEYS = 200_000

_GEAR = np.random.default_rng(3).integers(0, 2**32, 256, dtype=np.uint32)
_SAFE = re.compile(r"(?<=\S)[ \n]")
#: Characters that all tools class alike; other texts are left to the tokenizers library.
_COMMON = re.compile(r"[\t\n\r -~¡-¬®-ɏ–—‘-”…€]*")


@dataclass
class Files:
    """Contents of a tokenizer's files; read on the driver and broadcast, since both have a fixed size."""

    tokenizer_json: str
    ranks: bytes
    pattern: str


def default_files(json_name: str = "byte_bpe_50k.json", ranks_name: str = "byte_bpe_50k.tiktoken") -> Files:
    import public_tokenizers

    with open(public_tokenizers.path(json_name), encoding="utf-8") as f, open(public_tokenizers.path(ranks_name), "rb") as g:
        return Files(f.read(), g.read(), public_tokenizers.PATTERN)


def chunk_ends(b: bytes) -> list[int]:
    """Ends of the content-defined chunks of ``b`` (UTF-8), always between characters."""
    if len(b) <= SHORTEST:
        return [len(b)] if b else []
    a = np.frombuffer(b, np.uint8)
    h = _GEAR[a]
    reach = 1
    while reach < WINDOW:
        h[reach:] = h[reach:] + (h[:-reach] << np.uint32(reach))
        reach *= 2
    marks = np.flatnonzero((h >> np.uint32(12)) & np.uint32(AVERAGE - 1) == 0) + 1
    ends, start = [], 0
    for m in [*marks.tolist(), len(b)]:
        while m - start > LONGEST:
            start += LONGEST
            while b[start] & 0xC0 == 0x80:
                start -= 1
            ends.append(start)
        while m < len(b) and b[m] & 0xC0 == 0x80:
            m += 1
        if m - start >= SHORTEST or m == len(b):
            if m > start:
                ends.append(m)
                start = m
    return ends


def chunks(b: bytes) -> list[bytes]:
    ends = chunk_ends(b)
    return [b[s:e] for s, e in zip([0, *ends], ends)]  # noqa: B905


def chunk_hash(chunk: bytes) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(chunk)


@dataclass
class Coder:
    """Encodes and decodes texts exactly as the tokenizers library does with no special tokens added."""

    files: Files

    def __post_init__(self):
        import tiktoken

        ranks = {base64.b64decode(t): int(i) for t, i in map(bytes.split, self.files.ranks.splitlines())}
        self._fast = tiktoken.Encoding("chunks", pat_str=self.files.pattern, mergeable_ranks=ranks, special_tokens={})
        self._added = {t["content"]: t["id"] for t in json.loads(self.files.tokenizer_json)["added_tokens"]}
        size = max([*ranks.values(), *self._added.values()]) + 1
        self._bytes = [b""] * size
        for token, i in [*ranks.items(), *((t.encode(), i) for t, i in self._added.items())]:
            self._bytes[i] = token
        self._decimal = [str(i) for i in range(size)]
        self._exact = None
        #: ids as they are stored
        self.stored = np.dtype(np.uint16 if size <= 1 << 16 else np.uint32)

    def encode_whole(self, text: str) -> list[int]:
        """Encode without chunks."""
        if _COMMON.fullmatch(text) and not any(t in text for t in self._added):
            return self._fast.encode_ordinary(text)
        if self._exact is None:
            from tokenizers import Tokenizer

            self._exact = Tokenizer.from_str(self.files.tokenizer_json)
            self._exact.no_truncation()
            self._exact.no_padding()
        return self._exact.encode(text, add_special_tokens=False).ids

    def prepare(self, chunk: str) -> tuple[str, list[int], str] | None:
        """Text before the first safe point of a chunk, ids up to its last one, text after it; None where it has no two."""
        first = _SAFE.search(chunk)
        if first is None:
            return None
        reach, last = 64, first.start()
        while reach < 2 * len(chunk):
            from_ = max(len(chunk) - reach, 1)
            found = [m.start() for m in _SAFE.finditer(chunk, from_)]
            if found:
                last = found[-1]
                break
            reach *= 2
        if last <= first.start():
            return None
        return chunk[: first.start()], self.encode_whole(chunk[first.start() : last]), chunk[last:]

    def encode(self, text: str, known: dict[bytes, tuple[str, list[int], str]]) -> list[int]:
        """Encode a text of which some chunks are ``known`` by their hashes, as ``prepare`` gives them."""
        if not known:
            return self.encode_whole(text)
        ids: list[int] = []
        open_, bare = "", []  # text since the last safe point; chunks that are not known
        for chunk in chunks(text.encode("utf-8")):
            entry = known.get(chunk_hash(chunk))
            if entry is None:
                bare.append(chunk)
                continue
            head, body, tail = entry
            join = open_ + b"".join(bare).decode("utf-8") + head
            if join:
                ids += self.encode_whole(join)
            ids += body
            open_, bare = tail, []
        rest = open_ + b"".join(bare).decode("utf-8")
        return ids + self.encode_whole(rest) if rest else ids

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self._bytes.__getitem__, ids)).decode("utf-8", "replace")

    def decimal(self, ids: list[int]) -> str:
        return ",".join(map(self._decimal.__getitem__, ids))


def _sent(spark: SparkSession, files: Files | None):
    """The contents of the files broadcast as a plain tuple: broadcasts are pickled by reference, and executors need no copy of this package."""
    return spark.sparkContext.broadcast(astuple(files or default_files()))


def coder_of(value: tuple | Files) -> Coder:
    """The coder of broadcast files."""
    return Coder(Files(*value) if isinstance(value, tuple) else value)


def _small(keys: DataFrame) -> DataFrame:
    """A stored table of keys, marked to be broadcast if it has few rows."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def shared_chunks(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of ``texts`` (``key``, ``text``): chunks that occur more than once, and the texts that hold them.

    Chunks are ``hash``, ``n`` (occurrences), ``owner`` (least key) and ``several`` (not all in one text and its copies);
    texts are ``key``, ``hash``, ``n`` and ``several``.
    """

    @F.pandas_udf("array<binary>")
    def hashes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield pd.Series([[chunk_hash(c) for c in chunks(t.encode("utf-8"))] for t in rows])

    held = cut(texts.select("key", F.explode(hashes("text")).alias("hash")))
    found = held.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("owner"), F.max("key").alias("last"))
    shared = cut(found.filter("n > 1").select("hash", "n", "owner", (F.col("owner") != F.col("last")).alias("several")))
    holders = join_unique(held, shared, ["hash"], "n").select("key", "hash", "n", "several").distinct()
    return shared, cut(holders)


def encode_chunks(texts: DataFrame, shared: DataFrame, files) -> DataFrame:
    """``hash``, ``head``, ``body`` (stored ids) and ``tail`` of every chunk that several of ``texts`` hold.

    A chunk is handed out by its owner and encoded once; chunks without two safe points are left out.
    """
    wanted = cut(shared.filter("several").groupBy(F.col("owner").alias("key")).agg(F.collect_list("hash").alias("hashes")))

    @F.pandas_udf("array<struct<hash: binary, chunk: string>>")
    def pick(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts_, hashes in batches:
            out = []
            for t, hs in zip(texts_, hashes, strict=True):
                own, left = [], set(hs)
                for c in chunks(t.encode("utf-8")):
                    h = chunk_hash(c)
                    if h in left:
                        left.discard(h)
                        own.append({"hash": h, "chunk": c.decode("utf-8")})
                out.append(own)
            yield pd.Series(out)

    @F.pandas_udf("head string, body binary, tail string")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        coder = coder_of(files.value)
        for rows in batches:
            found = [coder.prepare(t) for t in rows]
            packed = [(None, None, None) if e is None else (e[0], np.asarray(e[1], coder.stored).tobytes(), e[2]) for e in found]
            yield pd.DataFrame(packed, columns=["head", "body", "tail"])

    handed = texts.join(_small(wanted), "key").select(F.explode(pick("text", "hashes")).alias("c")).select("c.hash", "c.chunk")
    dealt = handed.repartition("hash")  # the chunks of a long text are encoded by many tasks
    # as deterministic, the filter would move below the exchange and take a second run of the encoder there, in the tasks that pick
    return cut(dealt.select("hash", encode.asNondeterministic()("chunk").alias("e")).select("hash", "e.*").filter("head is not null"))


def _encode(docs: DataFrame, files: Files | None, kind: str, finish: Callable) -> DataFrame:
    """The columns of ``docs`` without ``text``, and ``__out``: what ``finish(coder, ids)`` makes of each text's ids, of type ``kind``."""
    small_batches(docs.sparkSession)
    shared_files = _sent(docs.sparkSession, files)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.withColumns({"text": text, "__key": F.unhex(F.sha2(text, 256))})
    own = [c for c in docs.columns if c != "text"]
    shared, holders = shared_chunks(rows.select(F.col("__key").alias("key"), "text"))
    again = _small(cut(holders.select(F.col("key").alias("__key")).distinct()))

    @F.pandas_udf(kind)
    def alone(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = coder_of(shared_files.value)
        for texts in batches:
            yield _series([finish(coder, coder.encode_whole(t)) for t in texts], kind)

    @F.pandas_udf(kind)
    def joined(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        coder = coder_of(shared_files.value)
        for texts, entries in batches:
            out = []
            for t, es in zip(texts, entries, strict=True):
                known = {e["hash"]: (e["head"], np.frombuffer(e["body"], coder.stored).tolist(), e["tail"]) for e in ([] if es is None else es)}
                out.append(finish(coder, coder.encode(t, known)))
            yield _series(out, kind)

    # texts without a chunk that occurs again stay where they are
    plain = rows.join(again, "__key", "left_anti").select(*own, alone("text").alias("__out"))
    repeated = rows.join(again, "__key", "left_semi")
    texts = cut(repeated.groupBy(F.col("__key").alias("key")).agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies")))
    encoded = encode_chunks(texts, shared, shared_files)
    counted = encoded.join(shared.select("hash", "n"), "hash")
    parts = join_unique(holders.filter("several").select("key", "hash"), cut(counted), ["hash"], "n")
    entries = parts.groupBy("key").agg(F.collect_list(F.struct("hash", "head", "body", "tail")).alias("entries"))
    done = texts.join(entries, "key", "left").select(F.col("key").alias("__key"), "copies", joined("text", "entries").alias("__out"))
    met = join_unique(repeated.select(*own, "__key"), cut(done), ["__key"], "copies")
    return plain.unionByName(met.select(*own, "__out"))


def _series(rows: list, kind: str):
    """Results as pandas gives them to Spark: a frame where ``kind`` names fields."""
    names = [f.split()[0] for f in kind.split(", ")]
    return pd.Series(rows) if len(names) == 1 else pd.DataFrame(rows, columns=names)


def encode_documents(docs: DataFrame, files: Files | None = None) -> DataFrame:
    """Token ids of every text: the columns of ``docs`` without ``text``, and ``ids``.

    Defined cases: a null text counts as empty and an empty text has no ids;
    special tokens spelled out in a text get their own ids, as in the
    tokenizers library; very long texts are encoded whole; repeated rows each
    get their ids; an empty table gives an empty result.
    """
    return _encode(docs, files, "array<int>", lambda coder, ids: ids).withColumnRenamed("__out", "ids")


def decode_documents(encoded: DataFrame, files: Files | None = None) -> DataFrame:
    """Texts of token ids: ``ids`` replaced by ``text``; null ids count as none."""
    small_batches(encoded.sparkSession)
    shared = _sent(encoded.sparkSession, files)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = coder_of(shared.value)
        for rows in batches:
            yield pd.Series([coder.decode([] if i is None else list(i)) for i in rows])

    return encoded.withColumn("text", run("ids")).drop("ids")


def digest_documents(docs: DataFrame, files: Files | None = None) -> DataFrame:
    """Encode and decode every text and give digests of both: ``doc_id``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``.

    The same as ``encode_documents`` and ``decode_documents``, without moving the ids out of the task.
    """

    def finish(coder: Coder, ids: list[int]) -> tuple[int, str, str]:
        digest = lambda t: hashlib.sha256(t.encode("utf-8")).hexdigest()
        return len(ids), digest(coder.decimal(ids)), digest(coder.decode(ids))

    out = _encode(docs.select("doc_id", "text"), files, "n_tokens long, ids_sha256 string, decoded_sha256 string", finish)
    return out.select("doc_id", "__out.*")
