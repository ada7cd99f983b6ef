"""Command line: init, step, label, run, status, estimate, report, export, verify, snapshot over a run's folder.

Exit codes: 0 done, 1 verification differs, 2 bad settings or labels, 3 no such input, 4 the run has stopped.
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import manifest as manifest_
from . import settings as settings_
from .run import STOPPED, TABLES, LabelError, Run
from .sinks import exports
from .sources import files

DONE, DIFFERS, BAD, LOST, OVER = 0, 1, 2, 3, 4


def _uri(path: str) -> str:
    return path if "://" in path else f"file://{Path(path).resolve()}"


def _load(spark: SparkSession, folder: str) -> Run:
    meta = json.loads((Path(folder) / "run.json").read_text(encoding="utf-8"))
    works, edges = files.graph(spark, _uri(meta["graph"]))
    return Run.load(_uri(f"{folder}/state"), works, edges, settings_.from_dict(meta["settings"]))


def _hashes(run: Run) -> dict[str, str]:
    return {name: manifest_.hash_rows(getattr(run, name)) for name in TABLES if name != "registry"}


def _save(run: Run, folder: str) -> None:
    run.manifest.record("saved", **_hashes(run))
    meta = json.loads((Path(folder) / "run.json").read_text(encoding="utf-8"))
    run.manifest.add_file(meta["graph"])
    run.save(_uri(f"{folder}/state"))
    (Path(folder) / "manifest.json").write_text(run.manifest.text(), encoding="utf-8")
    with open(Path(folder) / "audit.jsonl", "w", encoding="utf-8") as f:
        f.writelines(f"{e}\n" for e in run.events)


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="citeweft", description="Iterative citation searching on Spark.")
    sub = p.add_subparsers(dest="verb", required=True)
    one = sub.add_parser("init")
    one.add_argument("folder")
    one.add_argument("--seeds", required=True)
    one.add_argument("--graph", required=True)
    one.add_argument("--config")
    for verb in ("step", "status", "report", "export", "verify"):
        sub.add_parser(verb).add_argument("folder")
    for verb, what in (("label", "labels"), ("run", "gold")):
        one = sub.add_parser(verb)
        one.add_argument("folder")
        one.add_argument(what)
    one = sub.add_parser("snapshot")
    one.add_argument("folder")
    one.add_argument("archive")
    one = sub.add_parser("estimate")
    one.add_argument("folder")
    one.add_argument("--method", default="chapman", choices=["chapman", "chao1", "loglinear"])
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("citeweft").getOrCreate()
    try:
        return _do(spark, a)
    except (LabelError, settings_.SettingsError) as e:
        print(e, file=sys.stderr)
        return BAD
    except FileNotFoundError as e:
        print(e, file=sys.stderr)
        return LOST


def _do(spark: SparkSession, a: argparse.Namespace) -> int:
    if a.verb == "init":
        import yaml

        data = yaml.safe_load(Path(a.config).read_text(encoding="utf-8")) if a.config else {}
        chosen = settings_.from_dict(data or {})
        for w in settings_.warnings(chosen):
            print(f"warning: {w}", file=sys.stderr)
        Path(a.folder).mkdir(parents=True, exist_ok=True)
        run = Run(*files.graph(spark, _uri(a.graph)), chosen)
        n = run.init(files.seeds(spark, _uri(a.seeds)))
        (Path(a.folder) / "run.json").write_text(json.dumps({"graph": str(Path(a.graph).resolve()), "settings": data or {}, "settings_hash": settings_.settings_hash(chosen)}, sort_keys=True, indent=1), encoding="utf-8")
        _save(run, a.folder)
        print(f"{n} seeds")
        return DONE if n else BAD
    if a.verb == "snapshot":
        print(f"{len(manifest_.snapshot(a.folder, a.archive))} files")
        return DONE
    run = _load(spark, a.folder)
    if a.verb == "verify":
        known = manifest_.Manifest.parse((Path(a.folder) / "manifest.json").read_text(encoding="utf-8"))
        found = manifest_.verify_replay(known, run.settings, {"saved": _hashes(run)})
        (Path(a.folder) / "verification.md").write_text(manifest_.report_text(found), encoding="utf-8")
        print("ok" if found["ok"] else "differs")
        return DONE if found["ok"] else DIFFERS
    if a.verb == "step":
        if run.phase == STOPPED:
            return OVER
        found = run.step()
        _save(run, a.folder)
        print(f"round {run.n}: {0 if found is None else found.count()} candidates")
        return OVER if run.phase == STOPPED else DONE
    if a.verb == "label":
        run.label(files.labels(spark, _uri(a.labels)))
        _save(run, a.folder)
        return OVER if run.phase == STOPPED else DONE
    if a.verb == "run":
        gold = files.gold(spark, _uri(a.gold)).withColumn("gold", F.lit(True))
        run.run_to_saturation(lambda c: c.join(gold, "key", "left").select("key", F.when(F.col("gold"), "include").otherwise("exclude").alias("decision")))
        _save(run, a.folder)
        print(f"stopped by {run.stopped_by} after {run.n} rounds")
    elif a.verb == "status":
        print(json.dumps({"phase": run.phase, "round": run.n, **run.counts()}, sort_keys=True))
    elif a.verb == "estimate":
        print(json.dumps(run.estimate(a.method), sort_keys=True, default=str))
    elif a.verb == "report":
        (Path(a.folder) / "report.md").write_text(run.report(), encoding="utf-8")
        (Path(a.folder) / "flow.svg").write_text(exports.flow_svg(run.counts()), encoding="utf-8")
    elif a.verb == "export":
        inc = run.works.join(run.decisions.where("decision = 'include'"), "key", "left_semi")
        folder = Path(a.folder).absolute().as_uri()
        for name, entries in (("ris", exports.ris(inc)), ("bib", exports.bibtex(inc))):
            exports.write_ordered(entries.select("key", F.concat("entry", F.lit("\n")).alias("line")), ["key"], f"{folder}/included.{name}")
        ways = run.provenance.where("parent is not null")
        back = F.col("direction") == "backward"
        edges = ways.select(F.when(back, F.col("parent")).otherwise(F.col("key")).alias("u"), F.when(back, F.col("key")).otherwise(F.col("parent")).alias("v"), "provider").groupBy("u", "v").agg(F.max("provider").alias("provider"))
        exports.write_graphml(run.works, edges, f"{folder}/graph.graphml")
    return DONE


if __name__ == "__main__":
    sys.exit(main())
