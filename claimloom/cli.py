"""Command line: ``run``, ``schema`` and ``lint``."""

from __future__ import annotations

import argparse
import json
import sys

from claimloom.config import ConfigError, OutputConfig, default_config


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="claimloom", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run", help="files to profiles")
    run.add_argument("-i", "--input", action="append", required=True, help="a file or folder; may be given several times")
    run.add_argument("-c", "--config", help="output configuration (JSON)")
    run.add_argument("--default", action="store_true", help="all fields (the default)")
    run.add_argument("-o", "--output", help="file to write; standard output if absent")
    run.add_argument("-f", "--format", default="json", help="json or ndjson")
    run.add_argument("--enrich", metavar="CACHE", help="Parquet table (key, answer) that may fill empty fields")
    run.add_argument("--client", metavar="MODULE:FUNCTION", help="asked (prompt -> answer) for what the cache of --enrich lacks; its answers are kept there")
    run.add_argument("-v", "--verbose", action="store_true", help="report sources without trust and over-merged clusters")
    sub.add_parser("schema", help="JSON Schema of the profile")
    lint = sub.add_parser("lint", help="check a configuration without data")
    lint.add_argument("config")
    return parser


def _run(args: argparse.Namespace) -> int:
    from claimloom import engine, render
    from claimloom.operators import enrich, fuse, link
    from claimloom.sources.files import claims_of, prose_of, read_files
    from claimloom.storage import stored

    config = OutputConfig.from_file(args.config) if args.config and not args.default else default_config()
    spark = engine.session()
    claims = claims_of(spark, args.input)
    clusters = stored(link.link(claims), "clusters")
    profiles = fuse.fuse(claims, clusters)
    if args.verbose:
        for row in link.unknown_sources(claims).take(20):
            print(f"unknown source: {row['source']}", file=sys.stderr)
        for row in link.over_merged(claims, clusters).take(20):
            print(f"possible over-merge: {', '.join(row['candidate_ids'])}", file=sys.stderr)
    settings = config.enrichment
    if args.enrich and settings and settings.enabled:
        context = enrich.contexts(profiles, claims, prose_of(read_files(spark, args.input)))
        client = enrich.client_named(args.client) if args.client else None
        profiles = enrich.run(profiles, context, args.enrich, settings.model, settings.fields, client)
    if args.format not in ("json", "ndjson"):
        print(f"unknown format {args.format!r}", file=sys.stderr)
        return 1
    if args.format == "ndjson" and args.output:
        render.write_lines(profiles, config, args.output)
        return 0
    text = (render.render_json if args.format == "json" else render.render_ndjson)(profiles, config)
    if args.output:
        render.write_text(text, args.output)
    else:
        sys.stdout.write(text)
    return 0


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    try:
        if args.command == "schema":
            from claimloom.schema import json_schema

            print(json.dumps(json_schema(), indent=2))
            return 0
        if args.command == "lint":
            from claimloom.plans.project import lint

            issues = lint(OutputConfig.from_file(args.config))
            for issue in issues:
                print(f"{issue.severity}: {issue.path} (from {issue.source_path}): {issue.message}")
            return int(any(i.severity == "error" for i in issues))
        return _run(args)
    except (ConfigError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    except Exception as e:  # noqa: BLE001  a failed query is one line here
        print(f"error: {str(e).splitlines()[0] if str(e) else type(e).__name__}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
