"""URL filter over a sorted digest array.

The list of rules becomes a sorted array of 64-bit xxhash keys beside the rules' full strings and
actions, packed into one block of bytes. Each Python worker writes the block to an unlinked file and
memory-maps it, so its pages are shared with the page cache and can be dropped. A url makes one
probe for each (host suffix, path prefix) that some rule's shape (labels, path length) allows;
probes of a batch are answered by one vectorised binary search, and a hit counts only if the
stored string is the probed one, so that collisions of digests change nothing.

A list beyond ``BLOCK_BYTES`` is cut into several blocks that are probed one after another: no
worker maps, and no broadcast carries, more than one block's bytes at a time.

Null urls and urls without ``://`` have an empty host and path; no rule fits them.
"""

from __future__ import annotations

import mmap
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 64 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The rules of the task, as (action, host, path).
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def pack(rules: Iterable[tuple[str, str, str]], limit: int = BLOCK_BYTES) -> list[bytes]:
    """Blocks of at most about ``limit`` bytes: counts, sorted keys, actions, string offsets, strings.

    A rule given twice is kept as given first.
    """
    seen: dict[str, int] = {}
    for action, host, path in rules:
        seen.setdefault(host.translate(str.maketrans(UPPER, LOWER)) + path, int(action == "block"))
    blocks, part, size = [], [], 0
    for name, action in [*seen.items(), (None, 0)]:
        if part and (name is None or size + len(name) + 17 > limit):
            part.sort()
            text = [n.encode() for _, n, _ in part]
            ends = np.cumsum([0, *map(len, text)], dtype=np.int64)
            blocks.append(np.int64(len(part)).tobytes() + np.array([k for k, _, _ in part], np.uint64).tobytes() + ends.tobytes() + np.array([a for _, _, a in part], np.uint8).tobytes() + b"".join(text))
            part, size = [], 0
        if name is not None:
            part.append((xxhash.xxh64_intdigest(name), name, action))
            size += len(name.encode()) + 17
    return blocks


def shapes(rules: Iterable[tuple[str, str, str]]) -> list[tuple[int, int]]:
    """The distinct (labels of the host, characters of the path) of the rules."""
    return sorted({(host.count(".") + 1, len(path)) for _, host, path in rules})


class Digests:
    """A memory-mapped block."""

    def __init__(self, block: bytes):
        with tempfile.TemporaryFile() as file:
            file.write(block)
            file.flush()
            self.map = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        n = int(np.frombuffer(self.map, np.int64, 1)[0])
        self.keys = np.frombuffer(self.map, np.uint64, n, 8)
        self.ends = np.frombuffer(self.map, np.int64, n + 1, 8 + 8 * n)
        self.actions = np.frombuffer(self.map, np.uint8, n, 16 + 16 * n)
        self.base = 16 + 17 * n

    def find(self, names: list[str]) -> np.ndarray:
        """Place of each name in the block, or -1."""
        probe = np.fromiter(map(xxhash.xxh64_intdigest, names), np.uint64, len(names))
        at = np.searchsorted(self.keys, probe)
        out = np.full(len(names), -1)
        for i in np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == probe).tolist():
            j, name = int(at[i]), names[i].encode()
            while j < len(self.keys) and self.keys[j] == probe[i]:
                if self.map[self.base + int(self.ends[j]) : self.base + int(self.ends[j + 1])] == name:
                    out[i] = j
                    break
                j += 1
        return out


def parts(frame: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds host and path."""
    url = F.coalesce(frame[url_col], F.lit(""))
    after = F.when(F.instr(url, "://") > 0, F.expr(f"substring(`{url_col}`, instr(`{url_col}`, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return frame.withColumns({"host": host, "path": path})


def judge(frame: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", default: str = "allow", limit: int = BLOCK_BYTES) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row.

    ``rule`` is the longest fitting rule's string, null where none fits; then the verdict is ``default``:
    a url that the digest array does not hold is not on the list.
    """
    rules = list(rules)
    blocks, allowed = pack(rules, limit), shapes(rules)
    base = parts(frame.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))).drop("url")
    kept = base.withColumns({"rule": F.lit(None).cast("string"), "blocked": F.lit(None).cast("boolean")})
    for block in blocks:
        kept = probe(kept, frame.sparkSession.sparkContext.broadcast(block), allowed)
    return kept.select("page_id", "host", "path", "rule", F.when(F.col("blocked").isNull(), default).when(F.col("blocked"), "block").otherwise("allow").alias("verdict"))


def probe(frame: DataFrame, block, allowed: list[tuple[int, int]]) -> DataFrame:
    """Replaces rule and blocked where this block has a longer fitting rule."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests = Digests(block.value)
        for batch in batches:
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            rule, blocked = batch.column("rule").to_pylist(), batch.column("blocked").to_pylist()
            rows, names = [], []
            for i, (host, path) in enumerate(zip(hosts, paths, strict=True)):
                labels = host.split(".")
                for n, length in allowed:
                    if host and n <= len(labels) and length <= len(path):
                        rows.append(i)
                        names.append(".".join(labels[-n:]) + path[:length])
            for at, i, name in zip(digests.find(names).tolist(), rows, names, strict=True):
                if at >= 0 and (rule[i] is None or len(name) > len(rule[i])):
                    rule[i], blocked[i] = name, bool(digests.actions[at])
            yield pa.record_batch([batch.column("page_id"), batch.column("host"), batch.column("path"), pa.array(rule, pa.string()), pa.array(blocked, pa.bool_())], batch.schema.names)

    return frame.mapInArrow(run, frame.schema)
