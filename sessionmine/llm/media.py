"""Media columns in content-defined chunks (operator 6).

A text's bytes become the samples of an 8-bit mono WAV file. A rolling gear hash cuts the
samples into chunks; chunks are known by their digests. Equal payloads are one object. A
chunk that several objects (or places) hold is stored once, in the chunk table; what only
one place holds stays in its object's row, so that most bytes never have to meet others in a
shuffle. An object's ordered chunk list says which is which. Reading puts the chunks back in
order and compares the payload's SHA-256 with the object's name.

`write` reads the texts once for the chunk lists and once more for each of `ROUNDS` slices of
the objects: a slice's bytes are moved, written and freed before the next, so the space needed
besides the store is a fraction of the input.

Defined results: a null text is stored like an empty one, as 64 zero bytes. Repeated rows
and null ids get a row each. An empty table gives an empty result. Further columns are
ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from .common import slices, stage

BLOCK = 64
RATE = 8000
MIN_CHUNK, CHUNK_BITS, MAX_CHUNK = 256, 10, 8192
ROUNDS = 3
_U = np.uint32


def _gear() -> np.ndarray:
    """A random word for each byte, from a mixing rule."""
    x = (np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(32)).astype(_U)


_GEAR = _gear()


def payload_of(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % BLOCK if raw else BLOCK)


def header_of(n: int) -> bytes:
    """Header of a WAV file with n 8-bit samples."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n)


def rolling(payload: bytes) -> np.ndarray:
    """Gear hash after each byte: the sum of the last 32 bytes' words, each shifted by its
    age. Doubling the window five times gives all positions at once."""
    h = _GEAR[np.frombuffer(payload, np.uint8)]
    for width in (1, 2, 4, 8, 16):
        older = np.zeros_like(h)
        older[width:] = h[:-width]
        h = h + (older << _U(width))
    return h


def cuts(payload: bytes) -> list[int]:
    """Ends of the chunks: after a byte whose hash starts with `CHUNK_BITS` zero bits, within
    the size limits."""
    n, last, out = len(payload), 0, []
    for at in np.flatnonzero(rolling(payload) >> _U(32 - CHUNK_BITS) == 0) + 1:
        while at - last > MAX_CHUNK:
            last += MAX_CHUNK
            out.append(last)
        if at - last >= MIN_CHUNK:
            last = int(at)
            out.append(last)
    while n - last > MAX_CHUNK:
        last += MAX_CHUNK
        out.append(last)
    return out + [n] if last < n else out


def chunks_of(payload: bytes) -> list[bytes]:
    ends = cuts(payload)
    return [payload[a:b] for a, b in zip([0, *ends], ends)]


def digest_of(chunk: bytes) -> bytes:
    return blake2b(chunk, digest_size=20).digest()


_LIST = "array<struct<digest:binary,length:int>>"
_LIST_TYPE = pa.list_(pa.struct([("digest", pa.binary()), ("length", pa.int32())]))
_MARK_TYPE = "array<struct<pos:int,own:boolean>>"


def _recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in slices(batches):
        payloads = [payload_of(t) for t in texts]
        lists = [[(digest_of(c), len(c)) for c in chunks_of(p)] for p in payloads]
        yield pa.RecordBatch.from_arrays([
            part.column(0), pa.array([len((t or "").encode()) for t in texts], pa.int64()),
            pa.array([sha256(p).hexdigest() for p in payloads]),
            pa.array([[{"digest": d, "length": n} for d, n in x] for x in lists], _LIST_TYPE)],
            names=["doc_id", "n_bytes", "object", "chunks"])


def _bodies(round_no: int, rounds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=5)
        for _, texts in slices(batches):
            new = {}
            for text in texts:
                payload = payload_of(text)
                name = sha256(payload).hexdigest()
                if int(name[:8], 16) % rounds == round_no and name not in new:
                    new[name] = press.compress(payload)
            yield pa.RecordBatch.from_arrays([pa.array(list(new), pa.string()), pa.array(list(new.values()), pa.binary())],
                                             names=["object", "body"])
    return run


_OBJECT = f"object string, header binary, chunks {_LIST}, shared array<int>, own binary, given array<struct<digest:binary,bytes:binary>>"
_OBJECT_TYPES = (pa.string(), pa.binary(), _LIST_TYPE, pa.list_(pa.int32()), pa.binary(),
                 pa.list_(pa.struct([("digest", pa.binary()), ("bytes", pa.binary())])))


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the object table from whole bodies: `own` has the chunks of this object only,
    `given` the shared chunks that this object brings to the chunk table."""
    unpress = zstandard.ZstdDecompressor()
    for batch in batches:
        rows = []
        for name, body, marks in zip(*(batch.column(i).to_pylist() for i in range(3))):
            payload = unpress.decompress(body)
            parts = chunks_of(payload)
            shared = {m["pos"]: m["own"] for m in marks or ()}
            rows.append((name, header_of(len(payload)), [{"digest": digest_of(c), "length": len(c)} for c in parts], sorted(shared),
                         b"".join(c for i, c in enumerate(parts) if i not in shared),
                         [{"digest": digest_of(c), "bytes": c} for i, c in enumerate(parts) if shared.get(i)]))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_OBJECT_TYPES)],
                                         names=["object", "header", "chunks", "shared", "own", "given"])


@dataclass(frozen=True)
class Store:
    """`documents(doc_id, n_bytes, object)`, `objects(object, header, chunks, shared, own, ...)`
    and the chunk table `chunks(digest, bytes)` of shared chunks."""

    documents: DataFrame
    objects: DataFrame

    @property
    def chunks(self) -> DataFrame:
        return self.objects.select(F.explode("given").alias("c")).select("c.digest", "c.bytes")


def write(docs: DataFrame, rounds: int = ROUNDS) -> Store:
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    recipes = stage(texts.mapInArrow(_recipes, f"doc_id {kind}, n_bytes long, object string, chunks {_LIST}"))
    uses = (recipes.select("object", "chunks").dropDuplicates(["object"])
            .select("object", F.posexplode("chunks").alias("pos", "c")).select("object", "pos", "c.digest"))
    uses = stage(uses)
    shared = stage(uses.groupBy("digest").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("object", "pos")).alias("first"))
                   .filter("k > 1").select("digest", "first"))
    marks = stage(uses.join(shared, "digest").groupBy("object").agg(F.collect_list(F.struct(
        "pos", ((F.col("first.object") == F.col("object")) & (F.col("first.pos") == F.col("pos"))).alias("own"))).alias("marks")))
    objects = None
    for i in range(rounds):
        bodies = texts.select("text").mapInArrow(_bodies(i, rounds), "object string, body binary").groupBy("object").agg(
            F.first("body").alias("body"))
        part = stage(bodies.join(marks, "object", "left").select("object", "body", F.col("marks").cast(_MARK_TYPE)).mapInArrow(_split, _OBJECT))
        objects = part if objects is None else objects.union(part)
    return Store(recipes.select("doc_id", "n_bytes", "object"), objects)


FEATURES = ("payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, "
            "verified boolean")
_FEATURE_TYPES = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_())


def rebuilt(chunks: list[dict], shared: list[int], own: bytes, fetched: dict[int, bytes]) -> bytes:
    """The payload from its ordered chunk list; a chunk with another digest is an error."""
    out, at, away = [], 0, set(shared)
    for i, c in enumerate(chunks):
        part = fetched[i] if i in away else own[at:at + c["length"]]
        at += 0 if i in away else c["length"]
        if len(part) != c["length"] or digest_of(part) != c["digest"]:
            raise ValueError("a chunk doesn't have its digest")
        out.append(part)
    return b"".join(out)


def features(header: bytes, payload: bytes, n_chunks: int) -> str:
    samples = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero(np.diff(samples >= samples.mean())))
    return (f"rate={struct.unpack_from('<I', header, 24)[0]};samples={len(samples)};mean={samples.mean():.4f};"
            f"rms={np.sqrt((samples ** 2).mean()):.4f};crossings={crossings};chunks={n_chunks}")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for name, header, chunks, shared, own, found in zip(*(batch.column(i).to_pylist() for i in range(6))):
            payload = rebuilt(chunks, shared, own, {f["pos"]: f["bytes"] for f in found or ()})
            media = header + payload
            digest = sha256(payload).hexdigest()
            rows.append((len(payload), digest, zlib.crc32(payload[-BLOCK:]), len(media), sha256(media).hexdigest(),
                         features(header, payload, len(chunks)), digest == name))
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[i] for r in rows], t) for i, t in enumerate(_FEATURE_TYPES)]],
                                         names=["object", *[x.split()[0] for x in FEATURES.split(", ")]])


def read(store: Store) -> DataFrame:
    """`doc_id, n_bytes` and `FEATURES` of every document, from the stored bytes."""
    row = ["object", "header", "chunks", "shared", "own"]
    none = F.lit(None).cast("array<struct<pos:int,bytes:binary>>").alias("found")
    alone = store.objects.filter(F.size("shared") == 0).select(*row, none)
    mixed = store.objects.filter(F.size("shared") > 0).select(*row)
    wanted = mixed.select("object", F.explode("shared").alias("pos"), "chunks").select(
        "object", "pos", F.get("chunks", F.col("pos"))["digest"].alias("digest"))
    fetched = stage(wanted.join(store.chunks, "digest").select("object", F.struct("pos", "bytes").alias("f")))
    found = fetched.groupBy("object").agg(F.collect_list("f").alias("found"))
    mixed = mixed.join(found, "object").select(*row, "found")
    read_back = stage(alone.mapInArrow(_read, f"object string, {FEATURES}").union(mixed.mapInArrow(_read, f"object string, {FEATURES}")))
    return store.documents.join(read_back, "object").drop("object")
