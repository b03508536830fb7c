"""URL filters by a sorted digest array.

Rules (host, path prefix, verdict) are stored as sorted 64-bit xxhash keys beside their full strings, in files that
workers memory-map. A url is probed with each of its host's suffixes and each prefix of its path that is as long as
some rule's path, by vectorised binary search; a found key counts only if the stored string is the same. The
longest rule wins, and of equally long ones that with the longer host. Urls without a rule get `default`.

Defined cases: null urls and urls without `://` have empty host and path and fit no rule; repeated rows are judged
alike; an empty table gives no rows; other columns are kept unless they are named like the results.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, mapped, mapped_folder, save

_ROWS = 4096


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = ascii_lower(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0))
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def store_rules(spark: SparkSession, rules: list[tuple[str, str]]) -> str:
    """Write (rule, verdict) pairs as digest array and strings; a rule is host and path, the latter from its first slash."""
    folder = mapped_folder(spark, "rules")
    by_key = sorted((xxhash.xxh64_intdigest(rule.encode()), rule, verdict) for rule, verdict in dict(rules).items())
    text = "".join(rule for _, rule, _ in by_key).encode()
    save(f"{folder}/keys.npy", np.array([k for k, _, _ in by_key], np.uint64))
    save(f"{folder}/ends.npy", np.cumsum([0, *(len(r.encode()) for _, r, _ in by_key)]).astype(np.int64))
    save(f"{folder}/text.npy", np.frombuffer(text, np.uint8))
    names = sorted({v for _, _, v in by_key})
    save(f"{folder}/verdict.npy", np.array([names.index(v) for _, _, v in by_key], np.int32))
    with open(f"{folder}/about.json", "w") as f:
        parts = [rule.partition("/") for _, rule, _ in by_key]
        json.dump({"names": names, "labels": max((h.count(".") + 1 for h, _, _ in parts), default=0), "lengths": sorted({len(s + p) for _, s, p in parts})}, f)
    return folder


def judge(pages: DataFrame, rules: list[tuple[str, str]], *, url: str = "url", default: str = "allow") -> DataFrame:
    """All columns of `pages`, then host, path, rule (null if none fits) and verdict."""
    folder = store_rules(pages.sparkSession, rules)
    host, path = host_and_path(F.col(url))
    d = pages.drop("host", "path", "rule", "verdict") if url not in ("host", "path", "rule", "verdict") else pages
    d = d.withColumns({"host": host, "path": path})

    def probe(batches):
        keys, ends, text, verdict = (mapped(f"{folder}/{n}.npy") for n in ("keys", "ends", "text", "verdict"))
        with open(f"{folder}/about.json") as f:
            about = json.load(f)
        for whole in batches:
            for start in range(0, len(whole), _ROWS):
                batch = whole.slice(start, _ROWS)
                tries, row, rank = [], [], []
                for i, (h, p) in enumerate(zip(batch.column("host").to_pylist(), batch.column("path").to_pylist())):
                    for n in range(1, about["labels"] + 1):
                        tail = h.rsplit(".", n)
                        suffix = h if len(tail) <= n else ".".join(tail[1:])
                        for size in about["lengths"]:
                            if size <= len(p):
                                tries.append(suffix + p[:size])
                                row.append(i)
                                rank.append((len(tries[-1]), len(suffix)))
                        if len(tail) <= n:
                            break
                digest = np.array([xxhash.xxh64_intdigest(t.encode()) for t in tries], np.uint64)
                low, high = np.searchsorted(keys, digest, "left"), np.searchsorted(keys, digest, "right")
                best: dict[int, tuple] = {}
                for k in np.flatnonzero(high > low):
                    for at in range(low[k], high[k]):  # keys that collide lie side by side
                        if text[ends[at] : ends[at + 1]].tobytes() == tries[k].encode() and rank[k] >= best.get(row[k], ((-1,),))[0]:
                            best[row[k]] = (rank[k], tries[k], about["names"][verdict[at]])
                none = (None, None, default)
                found = [best.get(i, none) for i in range(len(batch))]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([f[1] for f in found], pa.string()), pa.array([f[2] for f in found], pa.string())], names=[*batch.schema.names, "rule", "verdict"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields), "rule string", "verdict string"])
    return d.mapInArrow(probe, schema)
