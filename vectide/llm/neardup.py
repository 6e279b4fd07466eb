"""Near-duplicate records by circulant MinHash, banding and exact verification.

* A record's set is that of all runs of ``run`` characters of its fields, joined
  by a blank, in lower case, with letters and digits only.
* Circulant MinHash: a first permutation spreads the set over a universe of
  ``UNIVERSE`` places; a second one, shifted by one place for each coordinate,
  gives the signature: coordinate k is the least ``pi[v + k]`` over the set. The
  shifted values of one element lie side by side, so a signature is the minimum
  over rows of one table.
* ``bands`` x ``rows`` coordinates are hashed by band; records that share a band
  are candidates. A pair of overlap J is missed with probability
  ``(1 - J**rows)**bands``: 0.0006 at 0.73 and 0.00001 at 0.8 by default.
* Candidates whose signatures (one byte a coordinate is kept) agree in a share
  more than ``SLACK`` below the threshold drop out: at 160 coordinates a pair at
  the threshold does so with a probability under 0.0001, one at 0.73 under 0.000001.
* The others are verified exactly on whole texts.
* A band that many records share, such as that of a family of one boilerplate, is
  compared in blocks of ``BLOCK`` records, block by block; pairs of copies are written
  in the same way. No key holds more than a block of either side.

Copies (equal text after normalising) are one class; classes are compared once. The
result is ``classes`` and ``links``, which grow with the records; ``pairs`` writes every
pair of records, copies too, where a caller wants them.
Nulls are empty, a text of fewer than ``run`` characters has no set and no pair,
an id given again counts once, null ids count for nothing, and an empty table
gives an empty table. Columns beside those named are never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.llm.components import components
from vectide.operators.hnsw import mix64
from vectide.shared import stored

UNIVERSE = 1 << 20
#: How far below the threshold an estimate may lie and still be verified.
SLACK = 0.15
#: Records of a band, or copies of a class, that meet in one place.
BLOCK = 512
_NOT_ALNUM = re.compile(r"[\W_]+")
_ASCII_REST = bytes(c for c in range(128) if not chr(c).isalnum())


def normalised(text: str) -> str:
    """Lower case, letters and digits only."""
    low = text.lower()
    return low.encode().translate(None, _ASCII_REST).decode() if low.isascii() else _NOT_ALNUM.sub("", low)


def run_set(text: str, run: int) -> set[str]:
    """All runs of ``run`` characters of a normalised text."""
    return {text[i : i + run] for i in range(len(text) - run + 1)}


@lru_cache(maxsize=2)
def _shifted(coords: int, seed: int) -> np.ndarray:
    """Row v: the second permutation at v, v+1, ..., circular."""
    pi = np.random.default_rng(seed).permutation(UNIVERSE).astype(np.int32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[: coords - 1]]), coords)


def places(text: str, run: int) -> np.ndarray:
    """The set of a normalised text after the first permutation, ascending."""
    code = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    n = len(code) - run + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint32)
    h = code[:n].copy()
    with np.errstate(over="ignore"):
        for k in range(1, run):
            h *= np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            h += code[k : k + n]
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x94D049BB133111EB)
    at = (h >> np.uint64(44)).astype(np.uint32)
    at.sort()
    return at[np.concatenate([[True], at[1:] != at[:-1]])]


def signature(at: np.ndarray, coords: int, seed: int = 11) -> np.ndarray:
    """Circulant MinHash of a set of places, not empty."""
    table = _shifted(coords, seed)
    best = None
    for lo in range(0, len(at), 512):
        part = table[at[lo : lo + 512]].min(axis=0)
        best = part if best is None else np.minimum(best, part)
    return best


def band_hashes(sigs: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 63-bit hash per signature and band; the band's number is part of it."""
    x = sigs.reshape(len(sigs), bands, rows).astype(np.uint64)
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(sigs), bands))
    with np.errstate(over="ignore"):
        for k in range(rows):
            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + x[:, :, k])
    return (h >> np.uint64(1)).astype(np.int64)


def _prepared(df: DataFrame, id_col: str, fields: list[str], run: int, bands: int, rows: int) -> DataFrame:
    text = F.concat_ws(" ", *[F.coalesce(F.col(f), F.lit("")) for f in fields])
    base = df.select(F.col(id_col).cast("string").alias("id"), text.alias("t")).where(F.col("id").isNotNull()).dropDuplicates(["id"])

    coords = bands * rows

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            norm = [normalised(t) for t in batch.column(1).to_pylist()]
            sets = [places(t, run) for t in norm]
            full = [k for k, at in enumerate(sets) if len(at)]
            sigs = np.stack([signature(sets[k], coords) for k in full]) if full else np.zeros((0, coords), np.int32)
            hashes = band_hashes(sigs, bands, rows)
            short = (mix64(sigs.astype(np.uint64)) & np.uint64(255)).astype(np.uint8)
            ends = np.zeros(len(norm) + 1, dtype=np.int32)
            ends[1:] = np.cumsum([len(at) > 0 for at in sets])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([xxhash.xxh3_128_digest(t) for t in norm], pa.binary()),
                    pa.array(norm, pa.string()),
                    pa.array([len(at) for at in sets], pa.int32()),
                    pa.ListArray.from_arrays(pa.array(ends * bands), pa.array(hashes.ravel())),
                    pa.Array.from_buffers(pa.binary(), len(norm), [None, pa.py_buffer(ends * coords), pa.py_buffer(short.ravel())]),
                ],
                names=["id", "digest", "norm", "size", "bands", "sig"],
            )

    return base.mapInArrow(work, "id string, digest binary, norm string, size int, bands array<bigint>, sig binary")


def in_blocks(rows: DataFrame, key: str, block: int) -> tuple[DataFrame, DataFrame]:
    """Both sides of a self-join on ``key`` and ``meet``, in which every two rows of a key
    meet once or, in one block, twice; ``key`` has ``n`` rows. ``id`` tells rows apart."""
    blocks = F.ceil(F.col("n") / F.lit(block)).cast("int")
    placed = rows.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    # left row of block i goes to (i, i), (i, i + 1), ...; right row of block j to (0, j), ..., (j, j)
    left = placed.withColumn("other", F.explode(F.expr("sequence(own, blocks - 1)"))).withColumn("meet", F.expr("own * blocks + other"))
    right = placed.withColumn("other", F.explode(F.expr("sequence(0, own)"))).withColumn("meet", F.expr("other * blocks + own"))
    return left.drop("n", "blocks", "other"), right.drop("n", "blocks", "other")


class NearDuplicates:
    """``classes`` (rep, id): every record with a set and its class of copies;
    ``links`` (a, b, overlap): class representatives ``a < b`` whose exact overlap
    is at least ``threshold``."""

    def __init__(self, df: DataFrame, id_col: str, fields: list[str], threshold: float = 0.8, run: int = 5, bands: int = 32, rows: int = 5) -> None:
        base = stored(_prepared(df, id_col, fields, run, bands, rows).where("size > 0"), "dup-sets")
        heads = base.groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
        heads = stored(heads, "dup-classes")
        many = heads.where("copies > 1").select("digest", "rep")
        members = base.select("id", "digest").join(many, "digest").select("rep", "id")
        alone = heads.where("copies = 1").select("rep", F.col("rep").alias("id"))
        self.classes = alone.unionByName(members)
        self.copies = members
        reps = base.join(heads.select(F.col("rep").alias("id")), "id", "left_semi")
        exploded = reps.select("id", "size", F.explode("bands").alias("h"))
        shared = exploded.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")  # most bands are a record's own
        left, right = in_blocks(exploded.join(shared, "h"), "h", BLOCK)
        slack = threshold * 0.97  # sizes are those of hashed sets, a little too small
        met = F.expr(f"x.h = y.h and x.meet = y.meet and x.id != y.id and (x.own != y.own or x.id < y.id) and x.size >= {slack} * y.size and y.size >= {slack} * x.size")
        candidates = left.alias("x").join(right.alias("y"), met).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()
        sigs = base.select("id", "sig")
        signed = candidates.join(sigs.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a").join(sigs.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b")
        coords, least = bands * rows, (threshold - SLACK) * bands * rows

        def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, coords) for k in (2, 3))
                    keep = pa.array((x == y).sum(axis=1) >= least)
                    yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

        candidates = stored(signed.select("a", "b", "sa", "sb").mapInArrow(likely, "a string, b string"), "dup-candidates")
        used = candidates.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        texts = stored(base.select("id", "norm").join(used, "id", "left_semi"), "dup-texts")
        paired = candidates.join(texts.select(F.col("id").alias("a"), F.col("norm").alias("ta")), "a").join(texts.select(F.col("id").alias("b"), F.col("norm").alias("tb")), "b")

        def verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sets = lru_cache(maxsize=64)(lambda t: run_set(t, run))
            for f in frames:
                got = []
                for a, b, ta, tb in zip(f.a, f.b, f.ta, f.tb):
                    x, y = sets(ta), sets(tb)
                    shared = len(x & y)
                    got.append((a, b, shared / (len(x) + len(y) - shared)))
                out = pd.DataFrame(got, columns=["a", "b", "overlap"])
                yield out[out.overlap >= threshold]

        self.links = stored(paired.mapInPandas(verify, "a string, b string, overlap double"), "dup-links")

    def pairs(self) -> DataFrame:
        """``id_a < id_b`` of records that overlap: every pair of copies, and every pair of
        different texts carried over to the members of both classes. As many rows as pairs."""
        sizes = self.copies.groupBy("rep").agg(F.count("*").alias("n"))
        held = self.copies.join(sizes, "rep")
        x, y = (side.alias(name) for side, name in zip(in_blocks(held, "rep", BLOCK), "xy"))
        inside = x.join(y, F.expr("x.rep = y.rep and x.meet = y.meet and x.id != y.id and (x.own != y.own or x.id < y.id)")).select(F.col("x.id").alias("p"), F.col("y.id").alias("q"))
        blocks = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
        placed = held.withColumn("part", F.pmod(F.xxhash64("id"), blocks).cast("int"))
        links = self.links.select("a", "b")
        for side in ("a", "b"):  # a link goes to every block of its class
            parts = sizes.select(F.col("rep").alias(side), blocks.alias("parts"))
            links = links.join(parts, side, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
            shown = placed.select(F.col("rep").alias(side), "part", F.col("id").alias("member"))
            links = links.join(shown, [side, "part"], "left").withColumn(side + "_id", F.coalesce("member", side)).drop("member", "part")
        every = links.select(F.col("a_id").alias("p"), F.col("b_id").alias("q")).unionByName(inside)
        return every.select(F.least("p", "q").alias("id_a"), F.greatest("p", "q").alias("id_b"))

    def groups(self) -> DataFrame:
        """``id, group_id, copies_of, links``: one row per record; ``group_id`` is the
        smallest id reached over links, ``links`` the number of other texts linked."""
        roots = components(self.links)
        degree = self.links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
        return (
            self.classes.join(roots.withColumnRenamed("node", "rep"), "rep", "left")
            .join(degree, "rep", "left")
            .select("id", F.coalesce("root", "rep").alias("group_id"), F.col("rep").alias("copies_of"), F.coalesce("links", F.lit(0)).alias("links"))
        )
