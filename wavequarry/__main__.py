"""The command line: ``python -m wavequarry FOLDER OUT [--layout 7.1.4 ...]``."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import fields

from wavequarry import catalog
from wavequarry.operators.upmix import Routing
from wavequarry.plans import manifest

#: Options that set a setting, with the kind of their value; ``None`` is a switch.
OPTIONS: dict[str, tuple[str, object, object]] = {
    "layout": ("layout", str, tuple(catalog.OUTPUT_LAYOUTS)), "input-layout": ("input_layout", str, tuple(catalog.INPUT_LAYOUTS)), "kind": ("kind", str, ("wav", "bed")), "bits": ("bits", int, (16, 24, 32)),
    "rate": ("rate", int, "positive"), "frame": ("frame", int, "positive"), "profile": ("profile", str, None), "intensity": ("intensity", float, None), "target": ("target", float, None), "eq": ("eq", str, tuple(catalog.EQ_PROFILES)),
    "compressor": ("compressor", str, tuple(catalog.COMPRESSOR_PROFILES)), "bass": ("bass", str, None), "limit": ("limit", float, "positive"), "preview": ("preview", float, "positive"), "preview-start": ("preview_start", float, None),
    "stems": ("stems", str, None), "match-reference": ("reference", str, None), "match-strength": ("match_strength", float, None), "match-db": ("match_db", float, "positive"), "downmix-surround": ("downmix_surround", float, (0.7071, 0.5, 0.0)),
}
SWITCHES = {"recursive": ("recursive", True), "overwrite": ("overwrite", True), "no-linked-energy": ("linked", False), "no-plan": ("plan", False), "no-loudness": ("loudness", False),
            "downmix": ("downmix", True), "no-match-spectrum": ("match_spectrum", False), "no-match-level": ("match_level", False)}


def positive(kind):
    def parse(text: str):
        value = kind(text)
        if value <= 0:
            raise argparse.ArgumentTypeError(f"{text} is not above 0")
        return value

    return parse


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("wavequarry", description="Audio files of a folder, upmixed to a larger layout and mastered.")
    p.add_argument("folder", nargs="?", help="where the WAV files are")
    p.add_argument("out", nargs="?", help="where theirs go; all executors must see it")
    p.add_argument("--manifest", help="a JSON or YAML document whose config block sets what the options don't")
    p.add_argument("--manifest-keys", action="store_true", help="print the keys of the config block")
    for name, (_, kind, rule) in OPTIONS.items():
        p.add_argument(f"--{name}", type=positive(kind) if rule == "positive" else kind, choices=rule if isinstance(rule, tuple) else None)
    for name in SWITCHES:
        p.add_argument(f"--{name}", action="store_true")
    for f in fields(Routing):
        p.add_argument(f"--{f.name.replace('_', '-')}-gain" if f.name in GAINS else f"--{f.name.replace('_', '-')}", type=int if f.name == "lfe_order" else float, dest=f"routing_{f.name}")
    p.add_argument("--set", action="append", default=[], metavar="K=V,...", help="settings by their names")
    p.add_argument("--dry-run", action="store_true", help="only say what would be done")
    p.add_argument("--json", action="store_true", help="a JSON document per file")
    p.add_argument("--report", help="a JSON file of the results")
    return p


GAINS = ("center", "lfe", "surround", "back", "height")


def overlay(args: argparse.Namespace) -> dict[str, object]:
    """The manifest's config block, over it what the command line says."""
    config: dict[str, object] = {}
    if args.manifest:
        config |= manifest.load_manifest(args.manifest).get("config", {})
    for pairs in args.set:
        config |= manifest.key_values(pairs)
    given = {key: getattr(args, name.replace("-", "_")) for name, (key, _, _) in OPTIONS.items()}
    given |= {key: value for name, (key, value) in SWITCHES.items() if getattr(args, name.replace("-", "_"))}
    given |= {f.name: getattr(args, f"routing_{f.name}") for f in fields(Routing)}
    return config | {k: v for k, v in given.items() if v is not None}


def main(argv: list[str] | None = None, spark=None) -> int:
    """0 if every file was done, 1 if one was rejected, 2 if the run could not begin."""
    from wavequarry import engine
    from wavequarry.plans import batch

    p = parser()
    args = p.parse_args(argv)
    if args.manifest_keys:
        print("\n".join(sorted({*(k for k, _, _ in OPTIONS.values()), *(k for k, _ in SWITCHES.values()), *(f.name for f in fields(Routing))})))
        return 0
    if not args.folder or not args.out:
        p.error("a folder and where the files go are needed")
    try:
        settings = engine.settings_from(overlay(args))
        if spark is None:
            from pyspark.sql import SparkSession

            spark = SparkSession.builder.appName("wavequarry").getOrCreate()
        if args.dry_run:
            found = engine.inspect(spark, args.folder, args.out, settings)
            rows = [r.asDict() for r in found.select("asset", "output", "layout", "rate_out", "channels_out", "reason").orderBy("asset").collect()]
        else:
            rows = [r.asDict() for r in engine.run(spark, args.folder, args.out, settings).orderBy("asset").collect()]
    except (ValueError, OSError) as e:
        print(f"wavequarry: {e}", file=sys.stderr)
        return 2
    for r in rows:
        print(json.dumps(r, sort_keys=True) if args.json else f"{r['asset']}: {r['reason'] or r.get('path') or r.get('output')}")
    rejected = sum(r["reason"] is not None for r in rows)
    if args.report:
        batch.write_report({"files": rows, "total": len(rows), "failed": rejected, "succeeded": len(rows) - rejected}, args.report)
    return 1 if rejected else 0


if __name__ == "__main__":
    raise SystemExit(main())
