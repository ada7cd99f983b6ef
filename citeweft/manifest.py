"""What a run has written: hashes by round, replay checks, response caches and snapshots."""

from __future__ import annotations

import hashlib
import json
import tarfile
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import scalars as S
from .functions.udfs import canonical, canonical_json
from .operators import verify
from .settings import drift, settings_hash


def hash_text(text: str) -> str:
    return "sha256:" + hashlib.sha256(text.encode()).hexdigest()


def hash_file(path: str | Path) -> str:
    out = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(1 << 20):
            out.update(part)
    return "sha256:" + out.hexdigest()


def hash_rows(df: DataFrame) -> str:
    """A hash of a DataFrame's rows that no order or partitioning changes: sums of 64-bit row hashes, and the count."""
    row = F.xxhash64(*(F.to_json(F.struct(c)) for c in sorted(df.columns)))
    r = df.agg(F.count("*").alias("n"), F.sum(row.cast("decimal(38,0)")).alias("s"), F.bit_xor(row).alias("x")).collect()[0]
    return hash_text(f"{r.n}|{r.s}|{r.x}")


class Manifest:
    """The record of a run: settings hash, and for each round the hashes of what came out."""

    def __init__(self, settings: object):
        self.data: dict = {"settings": json.loads(canonical(_settings(settings))), "settings_hash": settings_hash(settings), "rounds": {}, "files": {}}

    def record(self, n: int, **hashes: str) -> None:
        """Adds or replaces a round."""
        self.data["rounds"][str(n)] = dict(sorted(hashes.items()))

    def add_file(self, path: str | Path) -> None:
        self.data["files"][str(path)] = hash_file(path)

    def text(self) -> str:
        return json.dumps(self.data, sort_keys=True, indent=1, ensure_ascii=False) + "\n"

    @classmethod
    def parse(cls, text: str) -> Manifest:
        out = cls.__new__(cls)
        out.data = json.loads(text)
        return out


def _settings(s: object) -> object:
    from .settings import _plain

    return _plain(s)


def verify_replay(manifest: Manifest, settings: object, recomputed: dict[int, dict[str, str]], cache: DataFrame | None = None) -> dict:
    """Holds a manifest against files as they are, rounds computed again, settings, and the cache's own hashes."""
    changed = [p for p, h in manifest.data["files"].items() if not Path(p).exists() or hash_file(p) != h]
    rounds = [f"{n}.{k}" for n, hashes in recomputed.items() for k, h in hashes.items() if manifest.data["rounds"].get(str(n), {}).get(k) != h]
    spoilt = 0 if cache is None else verify.integrity(cache).where("not (key_ok and body_ok)").count()
    moved = drift(manifest.data["settings"], settings)
    return {"files": changed, "rounds": rounds, "settings": moved, "cache": spoilt, "ok": not (changed or rounds or moved or spoilt)}


def report_text(found: dict, counts: DataFrame | None = None) -> str:
    """A verification in Markdown; counts: drift classes."""
    out = ["# Verification", "", f"Result: {'ok' if found['ok'] else 'differs'}.", *(f"- file changed: {x}" for x in found["files"]), *(f"- round differs: {x}" for x in found["rounds"]), *(f"- setting: {x}" for x in found["settings"])]
    if found["cache"]:
        out.append(f"- spoilt cache entries: {found['cache']}")
    if counts is not None:
        out += ["", "| Provider | Class | Entries |", "|-|-|-|", *(f"| {r.provider or 'all'} | {r['class']} | {r.n} |" for r in counts.orderBy("provider", "class").collect())]  # a row for each class and provider
    return "\n".join([*out, ""])


def cache_entries(responses: DataFrame) -> DataFrame:
    """Responses (provider, method, params, http_status, retrieved_at, body) as content-addressed entries."""
    params, body = canonical_json("params"), canonical_json("body")
    rows = responses.withColumn("params", params).withColumn("body", body)
    return rows.select(S.request_key(F.col("provider"), F.col("method"), F.col("params")).alias("cache_key"), "provider", "method", "params", "retrieved_at", "http_status", S.response_hash(F.col("body")).alias("response_hash"), F.lit("{}").alias("provider_version"), "body")


def write_cache(entries: DataFrame, path: str) -> None:
    """JSON lines in folders by the first two characters of the key."""
    entries.withColumn("prefix", F.substring("cache_key", 1, 2)).repartition("prefix").sortWithinPartitions("cache_key").write.mode("append").partitionBy("prefix").json(path)


def lookup(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests (provider, method, params) with what the cache answers; ``hit`` tells."""
    asked = requests.withColumn("cache_key", S.request_key(F.col("provider"), F.col("method"), canonical_json("params")))
    return asked.join(cache.select("cache_key", "http_status", "response_hash", "body"), "cache_key", "left").withColumn("hit", F.col("response_hash").isNotNull())


def snapshot(folder: str | Path, archive: str | Path) -> list[str]:
    """A run's folder as .tar.gz, names sorted, times and owners left out, so that equal folders give equal archives."""
    names = sorted(p for p in Path(folder).rglob("*") if p.is_file())
    import gzip

    with open(archive, "wb") as raw, gzip.GzipFile(fileobj=raw, mode="wb", mtime=0, filename="") as z, tarfile.open(fileobj=z, mode="w") as tar:
        for p in names:
            info = tar.gettarinfo(p, str(p.relative_to(folder)))
            info.mtime = info.uid = info.gid = 0
            info.uname = info.gname = ""
            with open(p, "rb") as f:
                tar.addfile(info, f)
    return [str(p.relative_to(folder)) for p in names]
